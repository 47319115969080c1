"""Hard negatives for contrastive training, from blocks along a Hilbert curve.

Vectors become integers, are ordered along a Hilbert curve over their components, and are
written as blocks of neighbours: one Parquet row each, with the least and greatest value of
every dimension (its zone map) in columns of their own, which can be read without the rest.

Anchors are put in chunks along the same curve. For an anchor and a block, interval
arithmetic over the zone map bounds all its scores there; a block is read for a window of
scores only if its bounds reach into the window and past the worst of what has been found
already. A first look at the most promising blocks finds something to compare with. The
bounds are exact, so nothing is missed: where vectors have no structure they leave out
little, and every anchor meets nearly all blocks.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packwright.session import stage

LEAST, MOST = -(1 << 63), (1 << 63) - 1
# Sums of whole numbers below this are exact in double precision, in any order.
EXACT = float(1 << 53)


@dataclass(frozen=True)
class Params:
    """A negative scores from ``low`` to ``high`` percent of the positive.

    A block or chunk has ``most_rows``, fewer where more would have over ``most_values``
    components. A task bounds ``zones_at_once`` blocks, and reads ``blocks_at_once``, for
    one chunk. ``first_look`` blocks are read per window to begin with.
    """

    every: int = 100
    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90
    scale: int = 256
    curve_bits: int = 4
    key_bytes: int = 32
    most_rows: int = 256
    most_values: int = 1 << 14
    zones_at_once: int = 4096
    blocks_at_once: int = 64
    first_look: int = 4


def usable(rows: DataFrame) -> DataFrame:
    """``vec_id, label, vector`` without nulls, and finite."""
    vector = F.transform("embedding", lambda x: x.cast("double"))
    kept = rows.select("vec_id", F.col("label").cast("long").alias("label"), vector.alias("vector"))
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return kept.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & sound)


def cells(v: np.ndarray, bits: int) -> np.ndarray:
    """Components on a grid of 2**bits: the sign, then how many binary digits there are."""
    half = 1 << (bits - 1)
    size = np.minimum(np.floor(np.log2(1 + np.abs(v))), half - 1).astype(np.int64)
    return np.where(v >= 0, half + size, half - 1 - size)


def hilbert_keys(grid: np.ndarray, bits: int) -> np.ndarray:
    """Place of each row of cells along the Hilbert curve, as bytes that sort alike.

    By rotations and reflections of nested cubes, one digit of all axes at a time, for all
    rows at once.
    """
    axes = grid.T.copy()
    n = len(axes)
    if not n:
        return np.zeros((len(grid), 0), dtype=np.uint8)
    for digit in range(bits - 1, 0, -1):
        bit, below = 1 << digit, (1 << digit) - 1
        for i in range(n):
            upper = axes[i] & bit != 0
            swapped = np.where(upper, 0, (axes[0] ^ axes[i]) & below)
            axes[0] ^= np.where(upper, below, swapped)
            axes[i] ^= swapped
    for i in range(1, n):
        axes[i] ^= axes[i - 1]
    turned = np.zeros_like(axes[0])
    for digit in range(bits - 1, 0, -1):
        turned ^= np.where(axes[-1] & (1 << digit), (1 << digit) - 1, 0)
    axes ^= turned
    digits = (axes[None, :, :] >> np.arange(bits - 1, -1, -1)[:, None, None]) & 1
    return np.packbits(digits.reshape(bits * n, -1).T.astype(np.uint8), axis=1)


def on_curve(rows: DataFrame, params: Params) -> DataFrame:
    """``dim, key, vec_id, label, vector``: whole numbers (as doubles), with their place on the curve."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array(batch.column(2).value_lengths(), dtype=np.int64)
            for dim in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == dim))
                v = np.floor(part.column(2).flatten().to_numpy().reshape(len(part), dim) * params.scale)
                keys = hilbert_keys(cells(v, params.curve_bits), params.curve_bits)[:, : params.key_bytes]
                offsets = pa.array(np.arange(len(part) + 1, dtype=np.int32) * dim)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(part), dim, dtype=np.int32)),
                        pa.array([k.tobytes() for k in keys], pa.binary()),
                        part.column(0),
                        part.column(1),
                        pa.ListArray.from_arrays(offsets, pa.array(v.ravel())),
                    ],
                    names=["dim", "key", "vec_id", "label", "vector"],
                )

    schema = "dim int, key binary, vec_id long, label long, vector array<double>"
    return rows.select(F.col("vec_id").cast("long"), "label", "vector").mapInArrow(place, schema)


BLOCK = (
    "block long, dim int, ids array<long>, labels array<long>, vectors array<double>, "
    "low array<double>, high array<double>, label_set array<long>"
)


def in_blocks(placed: DataFrame, params: Params) -> DataFrame:
    """Neighbours on the curve as blocks: one row each, with its zone map.

    Rows are dealt out by ranges of the key and then the id, so that any number of equal
    vectors spreads over tasks.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 40
        held, dim = [], -1

        def block() -> pa.RecordBatch:
            ids, labels, v = (np.concatenate(x) for x in zip(*held))
            one = lambda values, kind: pa.array([values], pa.list_(kind))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([number], pa.int64()),
                    pa.array([dim], pa.int32()),
                    one(ids, pa.int64()),
                    one(labels, pa.int64()),
                    one(v.ravel(), pa.float64()),
                    one(v.min(axis=0), pa.float64()),
                    one(v.max(axis=0), pa.float64()),
                    one(np.unique(labels), pa.int64()),
                ],
                names=[c.split()[0] for c in BLOCK.split(", ")],
            )

        for batch in batches:
            dims = batch.column(0).to_numpy()
            at = 0
            while at < len(dims):
                if dims[at] != dim and held:
                    yield block()
                    held, number = [], number + 1
                dim = int(dims[at])
                room = max(1, min(params.most_rows, params.most_values // max(1, dim))) - sum(len(h[0]) for h in held)
                n = min(room, int(np.searchsorted(dims, dim, side="right")) - at)
                part = batch.slice(at, n)
                held.append((part.column(1).to_numpy(), part.column(2).to_numpy(), part.column(3).flatten().to_numpy().reshape(n, dim)))
                at += n
                if n == room:
                    yield block()
                    held, number = [], number + 1
        if held:
            yield block()

    order = ["dim", "key", "vec_id"]
    ranged = placed.repartitionByRange(*order).sortWithinPartitions(*order, "label")
    return ranged.select("dim", "vec_id", "label", "vector").mapInArrow(cut, BLOCK)


def matrix(values, n: int) -> np.ndarray:
    return np.asarray(values, dtype=np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def products(a: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers, exact. One beyond 64 bits is an error."""
    largest = np.abs(a).max(initial=0) * np.abs(v).max(initial=0) * max(1, a.shape[1])
    if largest < EXACT:
        return np.rint(a @ v.T).astype(np.int64)
    whole = lambda x: np.array([[int(c) for c in row] for row in x], dtype=object).reshape(x.shape)
    return (whole(a) @ whole(v).T).astype(np.int64)


def score_bounds(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest score of each row of ``a`` with anything inside each box."""
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    least, most = up @ low.T + down @ high.T, up @ high.T + down @ low.T
    size = np.abs(a) @ np.maximum(np.abs(low), np.abs(high)).T
    slack = np.where(size < EXACT, 0.0, size * 1e-9)
    return least - slack, most + slack


def targets_of(chunk: dict) -> tuple[np.ndarray, ...]:
    """Anchor, window and worst useful score of each target of a chunk."""
    return tuple(np.asarray(chunk[c], dtype=np.int64) for c in ("t_pos", "t_low", "t_high", "t_floor"))


def which_blocks(same: bool, first_look: int | None):
    """A function of chunks and zone maps to ``chunk, block, t``: the targets each block is read for.

    With ``first_look`` only so many blocks per target, those that promise most.
    """

    def bound(chunks: pa.Table, zones: pa.Table) -> pa.Table:
        out: list[tuple[int, int, list[int]]] = []
        n = len(zones) if len(chunks) else 0
        if n:
            low, high = (matrix(zones.column(c).combine_chunks().flatten().to_numpy(), n) for c in ("low", "high"))
            blocks, sets = zones.column("block").to_numpy(), zones.column("label_set").to_pylist()
        for chunk in chunks.to_pylist() if n else ():
            v = matrix(chunk["vectors"], len(chunk["ids"]))
            pos, t_low, t_high, t_floor = targets_of(chunk)
            if not len(pos):
                continue
            least, most = score_bounds(v, low, high)
            fits = np.array([[(label in s) if same else s != [label] for s in sets] for label in chunk["labels"]], dtype=bool)
            floor = np.maximum(t_low, t_floor)
            reach = fits[pos] & (most[pos] >= floor[:, None]) & (least[pos] <= t_high[:, None])
            if first_look is not None and n > first_look:
                middle = (least[pos] + most[pos]) / 2
                promise = np.where(t_high[:, None] == MOST, most[pos], -np.abs(middle - t_high[:, None]))
                promise = np.where(reach, promise, -np.inf)
                chosen = np.zeros_like(reach)
                np.put_along_axis(chosen, np.argpartition(-promise, first_look - 1, axis=1)[:, :first_look], True, axis=1)
                reach &= chosen
            for b in np.flatnonzero(reach.any(axis=0)).tolist():
                out.append((chunk["block"], int(blocks[b]), np.flatnonzero(reach[:, b]).tolist()))
        columns = list(zip(*out)) or [(), (), ()]
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32())]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["chunk", "block", "t"])

    return bound


def best_of(t: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` of each target: highest score, then smallest id."""
    order = np.lexsort((ids, -scores, t))
    ordered = t[order]
    begins = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(t) else np.zeros(0, np.int64)
    rank = np.arange(len(t)) - np.repeat(begins, np.diff(np.append(begins, len(t))))
    return order[rank < k]


def read_blocks(same: bool, k: int):
    """A function of the blocks read for a chunk, and the chunk, to the first ``k`` of each target there."""

    def read(blocks: pa.Table, chunks: pa.Table) -> pa.Table:
        found = [np.zeros(0, dtype=np.int64)] * 3
        chunk = chunks.slice(0, 1).to_pylist()[0] if len(blocks) and len(chunks) else None
        if chunk:
            anchors = matrix(chunk["vectors"], len(chunk["ids"]))
            own_ids, own_labels = np.asarray(chunk["ids"]), np.asarray(chunk["labels"])
            pos, t_low, t_high, t_floor = targets_of(chunk)
            floor = np.maximum(t_low, t_floor)
            for row in range(len(blocks)):
                one = {c: blocks.column(c)[row].values.to_numpy() for c in ("t", "ids", "labels", "vectors")}
                t, ids, labels = one["t"].astype(np.int64), one["ids"], one["labels"]
                used, of_t = np.unique(pos[t], return_inverse=True)
                scores = products(anchors[used], matrix(one["vectors"], len(ids)))[of_t]
                alike = labels[None, :] == own_labels[pos[t]][:, None]
                ok = (alike if same else ~alike) & (ids[None, :] != own_ids[pos[t]][:, None])
                ok &= (scores >= floor[t][:, None]) & (scores <= t_high[t][:, None])
                at, column = np.nonzero(ok)
                found = [np.concatenate(x) for x in zip(found, (t[at], ids[column], scores[at, column]))]
                kept = best_of(*found, k)
                found = [x[kept] for x in found]
                # What is worse than the k-th found cannot come out any more.
                full, first = np.unique(found[0], return_index=True)
                ends = np.append(first[1:], len(found[0]))
                done = ends - first == k
                floor[full[done]] = np.maximum(floor[full[done]], found[2][ends[done] - 1])
        numbers = np.full(len(found[0]), chunk["block"] if chunk else 0, dtype=np.int64)
        return pa.table([numbers, *found], names=["chunk", "t", "vec_id", "score"])

    return read


def dealt(n: int, at_once: int) -> int:
    return max(1, -(-n // at_once))


def look(chunks: DataFrame, blocks: DataFrame, n_blocks: int, k: int, same: bool, first_look: int | None, params: Params) -> DataFrame:
    """``chunk, t, vec_id, score, rank``: the first ``k`` of each target in the blocks read for it."""
    n_zones, n_groups = dealt(n_blocks, params.zones_at_once), dealt(n_blocks, params.blocks_at_once)
    number = lambda n: F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")
    zones = blocks.select("dim", "block", "low", "high", "label_set", number(n_zones).alias("zone"))
    # A chunk goes to every group of zone maps: a few hundredths of the blocks' size.
    asking = chunks.withColumn("zone", F.explode(F.sequence(F.lit(0), F.lit(n_zones - 1))))
    zones = zones.withColumn("part", F.lit(0))
    parted = asking.withColumn("part", F.lit(0))
    needed = parted.groupBy("dim", "zone", "part").cogroup(zones.groupBy("dim", "zone", "part"))
    pairs = stage(needed.applyInArrow(which_blocks(same, first_look), "chunk long, block long, t array<int>"), "needed-blocks")
    payload = blocks.select("block", "ids", "labels", "vectors")
    to_read = pairs.join(payload, "block").withColumn("task", number(n_groups))
    tasks = pairs.select("chunk", number(n_groups).alias("task")).distinct()
    asked = tasks.join(chunks.withColumnRenamed("block", "chunk_no"), F.col("chunk") == F.col("chunk_no")).drop("chunk_no")
    asked = asked.select(F.col("chunk").alias("of_chunk"), F.col("task").alias("of_task"), F.col("chunk").alias("block"), "ids", "labels", "vectors", "t_pos", "t_low", "t_high", "t_floor")
    found = (
        to_read.select("chunk", "task", "t", "ids", "labels", "vectors")
        .groupBy("chunk", "task")
        .cogroup(asked.groupBy("of_chunk", "of_task"))
        .applyInArrow(read_blocks(same, k), "chunk long, t long, vec_id long, score long")
    )
    order = Window.partitionBy("chunk", "t").orderBy(F.desc("score"), "vec_id")
    return found.select("*", F.row_number().over(order).alias("rank")).where(F.col("rank") <= k)


def search(chunks: DataFrame, blocks: DataFrame, n_blocks: int, k: int, same: bool, params: Params) -> DataFrame:
    """``look`` over all blocks that can matter, after a first look at a few.

    ``chunks`` are blocks of anchors with targets: ``t_pos`` (which anchor), ``t_low``, ``t_high``.
    """
    plain = chunks.withColumn("t_floor", F.transform("t_pos", lambda _: F.lit(LEAST).cast("long")))
    first = look(plain, blocks, n_blocks, k, same, params.first_look, params)
    kth = first.where(F.col("rank") == k).groupBy("chunk").agg(F.map_from_entries(F.collect_list(F.struct("t", "score"))).alias("kth"))
    joined = chunks.join(stage(kth, "worst-found"), F.col("block") == F.col("chunk"), "left").drop("chunk")
    worst = lambda _, i: F.coalesce(F.try_element_at("kth", i.cast("long")), F.lit(LEAST).cast("long"))
    floored = joined.withColumn("t_floor", F.transform("t_pos", worst)).drop("kth")
    return look(floored, blocks, n_blocks, k, same, None, params)


def percent_of(score: str, percent: int, up: bool) -> Column:
    """``percent`` of a whole number, rounded up or down to a whole number."""
    signed = -percent if up else percent
    down = F.expr(f"({signed}L * {score} - pmod({signed}L * {score}, 100L)) div 100L")
    return -down if up else down


def mine(rows: DataFrame, params: Params = Params()) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``rows`` has ``vec_id, embedding, label``. Anchors are ids divisible by ``every``. An
    anchor's positives are its first other rows of the same label, the negatives of a
    positive the first of other labels that score within the window. Scores are inner
    products of components times ``scale``, rounded down; higher ones come first, then
    smaller ids. Rows with a null id, label, vector or component, or one that is not finite,
    take no part. Vectors of another length than the anchor's have no product with it and
    are passed over. Rows that repeat an id are rows like others, but never another row to
    their own anchor, and an anchor's id counts once, with its least vector and label.
    Further columns are left alone. Without usable rows there are none.
    """
    sound = usable(rows)
    blocks = stage(in_blocks(on_curve(sound, params), params), "curve-blocks")
    asking = on_curve(sound.where(F.col("vec_id") % params.every == 0), params)
    once = asking.groupBy("vec_id").agg(F.min(F.struct("dim", "vector", "label", "key")).alias("r")).select("vec_id", "r.*")
    anchors = stage(in_blocks(once, params).drop("low", "high", "label_set"), "anchors")
    n_blocks = blocks.count()

    each = F.sequence(F.lit(0), F.size("ids") - 1)
    wide = lambda value: F.transform("ids", lambda _: F.lit(value).cast("long"))
    asked = anchors.withColumns({"t_pos": each, "t_low": wide(LEAST), "t_high": wide(MOST)})
    nearest = search(asked, blocks, n_blocks, params.positives, True, params)
    positives = stage(nearest.withColumnRenamed("vec_id", "positive_id").withColumnRenamed("score", "positive_score"), "positives")

    window = F.struct(
        F.col("t").cast("int").alias("pos"),
        F.col("rank").alias("no"),
        percent_of("positive_score", params.low, True).alias("low"),
        percent_of("positive_score", params.high, False).alias("high"),
        "positive_id",
        "positive_score",
    )
    windows = positives.groupBy("chunk").agg(F.array_sort(F.collect_list(window)).alias("windows"))
    asked = anchors.join(windows, F.col("block") == F.col("chunk")).drop("chunk")
    asked = stage(asked.select("*", *(F.col(f"windows.{c}").alias(f"t_{c}") for c in ("pos", "low", "high"))), "windows")
    found = search(asked.drop("windows"), blocks, n_blocks, params.negatives, False, params)
    named = asked.select(F.col("block").alias("chunk"), "ids", F.posexplode("windows").alias("t", "w")).select(
        "chunk", F.col("t").cast("long").alias("t"), F.get("ids", F.col("w.pos")).alias("anchor_id"), "w.positive_id", "w.positive_score"
    )
    return found.join(named, ["chunk", "t"]).select(
        "anchor_id",
        "positive_id",
        "rank",
        F.col("vec_id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )
