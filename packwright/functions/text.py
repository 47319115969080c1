"""Words and their stand-in ids, as column expressions."""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EMPTY_IDS = "array<int>"


def words(text: Column) -> Column:
    """Split on one space; two spaces in a row leave an empty word between them."""
    return F.split(text, " ", -1)


def word_ids(text: Column) -> Column:
    """One id per word: the first seven hex digits of its md5. No text, no ids."""
    return _word_ids_udf()(text)


# Bytes of text cut into words at a time: a worker holds the words of so many, whatever the
# batches of the engine. A longer text is cut alone.
BYTES_PER_CUT = 1 << 23


def _word_ids_udf(bytes_per_cut: int = BYTES_PER_CUT):
    """Words are cut and told apart as whole columns; the digest is taken of each different word."""

    def ids_of_words(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from hashlib import md5

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def ids_of_each(words: pa.Array) -> np.ndarray:
            raw = words.cast(pa.binary())
            ends = np.frombuffer(raw.buffers()[1], dtype=np.int32)[raw.offset :][: len(raw) + 1].tolist()
            held = raw.buffers()[2].to_pybytes() if len(raw) else b""
            each = [held[a:b] for a, b in zip(ends, ends[1:])]
            try:
                words.validate(full=True)
            except pa.ArrowInvalid:  # no UTF-8: as the engine reads it
                each = [w.decode("utf-8", "replace").encode() for w in each]
            digests = b"".join([md5(w).digest() for w in each])
            return (np.frombuffer(digests, dtype=">u4")[::4] >> 4).astype(np.int32)

        def ids_of(texts: pa.Array) -> pa.Array:
            cut = pc.split_pattern(texts, " ")
            sizes = pc.fill_null(pc.list_value_length(cut), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            known = cut.flatten().dictionary_encode()
            ids = ids_of_each(known.dictionary)[known.indices.to_numpy(zero_copy_only=False)]
            bare = pc.fill_null(pc.equal(texts, ""), False).to_numpy(zero_copy_only=False)
            if bare.any():
                ids = ids[~np.repeat(bare, sizes)]
                sizes[bare] = 0
            offsets = np.zeros(len(texts) + 1, dtype=np.int32)
            np.cumsum(sizes, out=offsets[1:])
            mask = texts.is_null() if texts.null_count else None
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids), mask=mask)

        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch), 0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(lengths, dtype=np.int64)
            first = before = 0
            while True:
                last = max(int(np.searchsorted(ends, before + bytes_per_cut, side="right")), first + 1)
                yield ids_of(batch.slice(first, last - first))
                if last >= len(batch):
                    break
                first, before = last, int(ends[last - 1])

    return F.arrow_udf(ids_of_words, T.ArrayType(T.IntegerType()))


def affix(ids: Column, prefix: Column | None = None, suffix: Column | None = None) -> Column:
    """``prefix + ids + suffix``; either side may be left out."""
    parts = [p for p in (prefix, ids, suffix) if p is not None]
    return F.concat(*parts) if len(parts) > 1 else ids


def eos_array(eos_id: int) -> Column:
    return F.array(F.lit(eos_id).cast("int"))


def constant_mask(flag: Column, ids: Column) -> Column:
    return F.array_repeat(flag.cast("int"), F.size(ids))


def n_tokens(ids: Column) -> Column:
    return F.size(ids).cast("bigint")


def array_total(values: Column) -> Column:
    """Sum of an int array."""
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint"))


def ids_digest(ids: Column) -> Column:
    """A short text that tells two id arrays apart."""
    return F.md5(F.array_join(ids.cast("array<string>"), ","))
