"""Number arrays: norms, scaling, losses over scores. All in double precision."""

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Terms that keep divisions away from zero.
MASKED_MEAN_EPSILON = 1e-5
CLIP_EPSILON = 1e-6
RMS_EPSILON = 1e-6
# Label left out of a mean loss; largest norm after clipping.
IGNORED_LABEL = -100
MAX_NORM = 1.0


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Work out ``value`` once per row, then ``body`` of it.

    A lambda of a higher-order function evaluates everything inside it for each
    element, so a row-level number used there has to be bound outside.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def doubles(values: Column) -> Column:
    return values.cast("array<double>")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def sum_of_squares(values: Column) -> Column:
    return F.aggregate(doubles(values), F.lit(0.0), lambda a, x: a + x * x)


def scale(values: Column, factor: Column) -> Column:
    return F.transform(doubles(values), lambda x: x * factor)


def masked_mean(values: Column, mask: Column, epsilon: float = MASKED_MEAN_EPSILON) -> Column:
    """Array form of the masked mean: the epsilon stays in the answer."""
    weighted = F.zip_with(doubles(values), doubles(mask), lambda x, m: x * m)
    return total(weighted) / (total(doubles(mask)) + F.lit(epsilon))


def rms_scale(values: Column, weights: Column | None = None, epsilon: float = RMS_EPSILON) -> Column:
    mean_square = sum_of_squares(values) / F.size(values)
    row = F.struct(
        doubles(values).alias("v"),
        (F.lit(1.0) / F.sqrt(mean_square + F.lit(epsilon))).alias("factor"),
    )
    scaled = let(row, lambda r: F.transform(r["v"], lambda x: x * r["factor"]))
    if weights is None:
        return scaled
    return F.zip_with(scaled, doubles(weights), lambda x, w: x * w)


def cross_entropy(scores: Column, label: Column) -> Column:
    """``log(sum(exp(scores))) - scores[label]``, label counted from zero.

    Null where the label lies outside the scores.
    """
    row = F.struct(doubles(scores).alias("v"), F.array_max(doubles(scores)).alias("top"))
    log_sum = let(
        row,
        lambda r: r["top"]
        + F.log(F.aggregate(r["v"], F.lit(0.0), lambda a, x: a + F.exp(x - r["top"]))),
    )
    return log_sum - F.get(doubles(scores), F.when(label >= 0, label))


def binary_cross_entropy(score: Column, target: Column) -> Column:
    x, y = score.cast("double"), target.cast("double")
    return F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))


def last_token_index(ids: Column, pad_id: Column | int | None) -> Column:
    """Zero-based place of the last token by counting non-pad ids; the last place without a pad id.

    It counts, so a pad inside the row shifts it, and a row of pads gives the last place.
    """
    if pad_id is None:
        return F.size(ids) - 1
    pad = pad_id if isinstance(pad_id, Column) else F.lit(pad_id)
    present = F.size(F.filter(ids, lambda x: x != pad))
    return F.when(present == 0, F.size(ids) - 1).otherwise(present - 1)


def last_token(values: Column, ids: Column, pad_id: Column | int | None) -> Column:
    return F.get(values, last_token_index(ids, pad_id))


def mask_positions(mask: Column) -> Column:
    """Running sum of a 0/1 mask minus one; places the mask leaves out get one. Null stays null.

    One running sum over each Arrow batch, less what it was where a row begins.
    """

    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch), 0).to_numpy(zero_copy_only=False)
            ones = pc.fill_null(batch.flatten(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            stops = np.cumsum(sizes.astype(np.int64))
            sums = np.concatenate(([0], np.cumsum(ones)))
            places = sums[1:] - np.repeat(sums[stops - sizes], sizes) - 1
            places[ones == 0] = 1
            offsets = np.concatenate(([0], stops)).astype(np.int32)
            rows = pa.ListArray.from_arrays(pa.array(offsets), pa.array(places.astype(np.int32)))
            if batch.null_count:
                rows = pc.if_else(batch.is_valid(), rows, pa.scalar(None, rows.type))
            yield rows

    return F.arrow_udf(count, "array<int>")(mask.cast("array<int>"))
