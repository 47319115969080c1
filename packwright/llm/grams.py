"""Rolling word n-grams of documents that may stand in a list, as rows for a join.

The filter is a bitmap of fixed size, whatever the list: a false alarm costs a row that
the join drops, and a full bitmap lets every n-gram through to the join.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packwright.llm.words import ALPHANUMERIC, Words, runs, signed, slices, split_words

FILTER_BITS = 1 << 22


class Sieve:
    """Bitmap over hashes of n-grams of the given numbers of words."""

    def __init__(self, flags: np.ndarray, sizes: list[int]):
        self.flags, self.sizes = flags, sizes

    def shared(self, docs: DataFrame):
        """A function that gives the sieve inside a task. Only arrays are broadcast: a class
        would have to be importable where the executors run."""
        flags, sizes = docs.sparkSession.sparkContext.broadcast(self.flags), self.sizes
        return lambda: Sieve(flags.value, sizes)

    def passing(self, words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and first words of the n-grams that may be in the list."""
        hashes, starts = runs(words, k)
        place = (hashes & np.uint64(FILTER_BITS - 1)).astype(np.int64)
        there = (self.flags[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
        return hashes[there], starts[there]


def bitmap(places: DataFrame, bits: int) -> np.ndarray:
    """Flags, eight to a byte, of ``place`` from 0 to ``bits`` - 1.

    Packed in Spark: the driver gets at most ``bits`` / 64 pairs of numbers, as Arrow.
    """
    bit = F.expr("shiftleft(1L, cast(place % 64 as int))")
    words = places.groupBy(F.expr("cast(place div 64 as int)").alias("at")).agg(F.bit_or(bit).alias("word"))
    packed = words.toArrow()
    flags = np.zeros(bits // 64, dtype="<i8")
    flags[packed.column("at").to_numpy()] = packed.column("word").to_numpy()
    return flags.view(np.uint8)


def sieve_of(listed: DataFrame) -> Sieve:
    """From ``hash, k``."""
    place = F.col("hash").bitwiseAND(F.lit(FILTER_BITS - 1))
    sizes = sorted(r[0] for r in listed.select("k").distinct().collect())
    return Sieve(bitmap(listed.select(place.alias("place")), FILTER_BITS), sizes)


def digest(text: bytes | None) -> int:
    return xxhash.xxh3_64_intdigest(text or b"")


def text_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[bytes | None]]]:
    """Slices of (id, UTF-8 text) batches."""
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        for begin, stop in slices(texts):
            yield ids.slice(begin, stop - begin), texts[begin:stop]


def map_texts(docs: DataFrame, fn: Callable[[pa.Array, list[bytes | None]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_batches(batches):
            yield from fn(ids, texts)

    return docs.select(docs.columns[0], F.col("text").cast("binary").alias("text")).mapInArrow(each, schema)


def gram_counts(docs: DataFrame, sieve: Sieve) -> DataFrame:
    """``hash, n``: how often listed n-grams occur in all documents, added up per task first."""
    shared = sieve.shared(docs)

    def count(ids: pa.Array, texts: list[bytes | None]) -> Iterator[pa.RecordBatch]:
        words, sieve = split_words(texts, ALPHANUMERIC), shared()
        found = np.concatenate([sieve.passing(words, k)[0] for k in sieve.sizes] or [np.zeros(0, np.uint64)])
        hashes, n = np.unique(found, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(signed(hashes)), pa.array(n.astype(np.int64))], names=["hash", "n"])

    return map_texts(docs.select("doc_id", "text"), count, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


def gram_rows(docs: DataFrame, sieve: Sieve, before: int, after: int) -> DataFrame:
    """Listed n-grams of documents with the words around them, and one row per document.

    ``doc_id, digest`` name a text; rows of the same id and text share it. Rows with null
    ``hash`` stand for a document; the others have the first word ``pos`` and the words
    ``from_word`` on: up to ``before`` words before the n-gram and ``after`` from its start.
    """
    shared = sieve.shared(docs)
    id_type = dict(docs.dtypes)["doc_id"]

    def find(ids: pa.Array, texts: list[bytes | None]) -> Iterator[pa.RecordBatch]:
        words, sieve = split_words(texts, ALPHANUMERIC), shared()
        n_words = np.diff(words.first)
        digests = signed(np.fromiter(map(digest, texts), dtype=np.uint64, count=len(texts)))
        found = [(h, s, np.full(len(h), k)) for k in sieve.sizes for h, s in [sieve.passing(words, k)]]
        hashes, starts, sizes = (
            [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.uint64)] + [np.zeros(0, np.int64)] * 2
        )
        owner = np.searchsorted(words.first, starts, side="right") - 1
        low = np.maximum(words.first[owner], starts - before)
        high = np.minimum(words.first[owner + 1], starts + after)
        around = [words.text(a, b) for a, b in zip(low, high)]
        doc = np.concatenate([np.arange(len(texts)), owner])
        absent = [None] * len(texts)
        of_doc = lambda x: pa.concat_arrays([pa.array(absent, pa.int64()), pa.array(x, pa.int64())])
        yield pa.RecordBatch.from_arrays(
            [
                ids.take(pa.array(doc)),
                pa.array(digests[doc]),
                pa.array(n_words[doc]),
                of_doc(signed(hashes)),
                of_doc(sizes),
                of_doc(starts - words.first[owner]),
                of_doc(low - words.first[owner]),
                pa.concat_arrays([pa.array(absent, pa.list_(pa.string())), pa.array(around, pa.list_(pa.string()))]),
            ],
            names=["doc_id", "digest", "n_words", "hash", "k", "pos", "from_word", "around"],
        )

    return map_texts(
        docs.select("doc_id", "text"),
        find,
        f"doc_id {id_type}, digest long, n_words long, hash long, k long, pos long, from_word long, around array<string>",
    )
