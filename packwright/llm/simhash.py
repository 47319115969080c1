"""Near-duplicate documents by SimHash, joined on deletion variants of fingerprint segments.

A fingerprint is cut into so few segments that of two that link one segment differs by at
most one bit. Every segment is indexed whole, and once per bit with that bit deleted (a
wildcard). Fingerprints with an equal whole segment meet there; those whose segments differ
in one bit meet in the variant without that bit, on opposite sides of it. All that meet are
verified on all bits.

Equal fingerprints are one class before anything else. What meets in a variant comes out as
a spanning star of each group, not as its pairs. A variant of many classes is first
connected by way of a hub, the class of most documents; only what does not link with the
hub meets all others, in blocks of a bounded size.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packwright.llm.grams import map_texts
from packwright.llm.neardup import components
from packwright.session import stage

BITS = 64


@dataclass(frozen=True)
class Params:
    """Fingerprints link at ``most`` or fewer differing bits.

    ``most // 2 + 1`` segments are the fewest of which one always differs by at most a bit;
    ``most`` is 2 at least, so that a segment and its number fit in one bigint.
    ``variant_rows`` bounds the classes of a variant that one task compares with each other:
    a quarter of a megabyte, and about a second for all pairs of them.
    """

    words: int = 4
    most: int = 4
    hash_seed: int = 42
    variant_rows: int = 16_384

    def __post_init__(self):
        if self.most < 2:
            raise ValueError("most has to be 2 at least")

    @property
    def segments(self) -> list[tuple[int, int]]:
        """(lowest bit, number of bits) of each segment."""
        n = self.most // 2 + 1
        ends = [BITS * i // n for i in range(n + 1)]
        return [(a, b - a) for a, b in zip(ends, ends[1:])]


def shingle_hashes(text: bytes | None, params: Params) -> list[int]:
    """The hash of every shingle, repeats included; all words as one where there are fewer."""
    # Without an argument, split() cuts bytes at the blanks 0x20 and 0x09 to 0x0D.
    words = (text or b"").lower().split()
    if not words:
        return []
    line, k, seed, digest = b" ".join(words), params.words, params.hash_seed, xxhash.xxh64_intdigest
    if len(words) <= k:
        return [digest(line, seed)]
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-k] + 1))
    return [digest(line[a:b], seed) for a, b in zip(starts.tolist(), ends[k - 1 :].tolist())]


def fingerprint(hashes: list[int]) -> int:
    """A bit is 1 if it is set in over half the hashes; without hashes all are 0."""
    if not hashes:
        return 0
    set_in = np.zeros(BITS, dtype=np.int64)
    for begin in range(0, len(hashes), 1 << 16):
        numbers = np.array(hashes[begin : begin + (1 << 16)], dtype="<u8")
        set_in += np.unpackbits(numbers.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * set_in > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a bigint) for each row."""
    id_type = dict(docs.dtypes)["doc_id"]

    def each(ids: pa.Array, texts: list[bytes | None]) -> Iterator[pa.RecordBatch]:
        numbers = np.array([fingerprint(shingle_hashes(t, params)) for t in texts], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([ids, pa.array(numbers.view(np.int64))], names=["doc_id", "fp"])

    return map_texts(docs.select("doc_id", "text"), each, f"doc_id {id_type}, fp long")


def variants(classes: DataFrame, params: Params) -> DataFrame:
    """``variant, fp, n_docs``: each class under its whole segments and their wildcard variants.

    A variant is a number of its own: which segment, which bit is deleted (none: the number of
    its bits), and the remaining bits where they stand.
    """
    made = []
    for number, (low, size) in enumerate(params.segments):
        segment = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << size) - 1))
        for deleted in range(size + 1):
            kept = segment.bitwiseAND(F.lit(((1 << size) - 1) & ~(1 << deleted if deleted < size else 0)))
            made.append(F.lit((number << 6 | deleted) << 48) + kept)
    return classes.select("fp", "n_docs", F.explode(F.array(*made)).alias("variant"))


def opposite(variant: np.ndarray, fp: np.ndarray, params: Params) -> tuple[np.ndarray, np.ndarray]:
    """Whether a bit is deleted in each variant, and what the fingerprint has there."""
    low = np.array([a for a, _ in params.segments], dtype=np.int64)
    size = np.array([n for _, n in params.segments], dtype=np.int64)
    number, deleted = variant >> 54, variant >> 48 & 63
    there = deleted < size[number]
    shift = np.where(there, low[number] + deleted, 0).astype(np.uint64)
    return there, (fp >> shift & np.uint64(1)).astype(bool) & there


def star_edges(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each connected member with the least member it is connected with."""
    label = np.arange(n)
    while len(a):
        least = np.minimum(label[a], label[b])
        following = label.copy()
        np.minimum.at(following, a, least)
        np.minimum.at(following, b, least)
        following = following[following]
        if (following == label).all():
            break
        label = following
    joined = np.flatnonzero(label != np.arange(n))
    return joined, label[joined]


def close_between(fp: np.ndarray, first: np.ndarray, second: np.ndarray, params: Params) -> tuple[np.ndarray, np.ndarray]:
    """Places that link, of one list and another: enough of them to connect what is connected.

    Goes over strips of ``first``. A strip keeps a star of what it connects, not its pairs.
    """
    found = [], []
    strip = max(1, (1 << 21) // max(1, len(second)))
    for begin in range(0, len(first), strip):
        rows = first[begin : begin + strip]
        a, b = np.nonzero(np.bitwise_count(fp[rows][:, None] ^ fp[second][None, :]) <= params.most)
        joined, least = star_edges(len(rows) + len(second), a, len(rows) + b)
        members = np.concatenate((rows, second))
        found[0].append(members[joined])
        found[1].append(members[least])
    empty = [np.zeros(0, dtype=np.int64)]
    return np.concatenate(found[0] or empty), np.concatenate(found[1] or empty)


def close_pairs(variant: np.ndarray, fp: np.ndarray, params: Params) -> tuple[np.ndarray, np.ndarray]:
    """Places of rows that meet in a variant and link; rows are in order of their variant."""
    begins = np.flatnonzero(np.concatenate(([True], variant[1:] != variant[:-1])))
    sizes = np.diff(np.concatenate((begins, [len(variant)])))
    wild, side = opposite(variant, fp, params)
    found_a, found_b = [], []
    # Small variants: rows that stand a given distance apart, over all of them at once.
    few = 32
    left = np.repeat(sizes, sizes) - (np.arange(len(variant)) - np.repeat(begins, sizes))
    left[np.repeat(sizes > few, sizes)] = 0
    rows = np.flatnonzero(left > 1)
    for apart in range(1, few):
        rows = rows[left[rows] > apart]
        if not len(rows):
            break
        other = rows + apart
        near = (np.bitwise_count(fp[rows] ^ fp[other]) <= params.most) & (~wild[rows] | (side[rows] != side[other]))
        found_a.append(rows[near])
        found_b.append(other[near])
    # Larger ones each by itself: whole segments all with all, wildcards side with side.
    for begin, size in zip(begins[sizes > few].tolist(), sizes[sizes > few].tolist()):
        rows = np.arange(begin, begin + size)
        first, second = (rows[~side[rows]], rows[side[rows]]) if wild[begin] else (rows, rows)
        a, b = close_between(fp, first, second, params)
        found_a.append(a)
        found_b.append(b)
    empty = [np.zeros(0, dtype=np.int64)]
    return np.concatenate(found_a or empty), np.concatenate(found_b or empty)


def compare_sorted(params: Params):
    """A function of batches (variant, fp) in order of the variant to links ``a, b``.

    A variant may begin in one batch and end in the next; its rows wait for its end.
    """

    def links(variant: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        a, b = close_pairs(variant, fp.view(np.uint64), params)
        joined, least = star_edges(len(fp), a, b)
        return pa.RecordBatch.from_arrays([pa.array(fp[joined]), pa.array(fp[least])], names=["a", "b"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        variant, fp = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for batch in batches:
            variant = np.concatenate((variant, batch.column(0).to_numpy()))
            fp = np.concatenate((fp, batch.column(1).to_numpy()))
            done = int(np.searchsorted(variant, variant[-1])) if len(variant) else 0
            if done:
                yield links(variant[:done], fp[:done])
                variant, fp = variant[done:], fp[done:]
        if len(variant):
            yield links(variant, fp)

    return compare


def compare_blocks(params: Params):
    """A function of one pair of blocks (``second`` tells which) to links that connect them."""

    def compare(table: pa.Table) -> pa.Table:
        fp = table.column("fp").to_numpy()
        second = table.column("second").to_numpy(zero_copy_only=False).astype(bool)
        left = np.flatnonzero(~second)
        right = np.flatnonzero(second) if second.any() else left
        bits = fp.view(np.uint64)
        joined, least = star_edges(len(fp), *close_between(bits, left, right, params))
        return pa.table({"a": fp[joined], "b": fp[least]})

    return compare


def in_large_variants(rows: DataFrame, large: DataFrame, params: Params) -> DataFrame:
    """Links ``a, b`` of variants of many classes: with their hub, and of what is left then."""
    members = stage(rows.join(large, "variant").select("variant", "fp", "n_docs"), "large-variants")
    hubs = members.groupBy("variant").agg(F.max(F.struct("n_docs", "fp"))["fp"].alias("hub"))
    distance = F.bit_count(F.col("fp").bitwiseXOR(F.col("hub")))
    near = F.when(distance <= params.most, 0).otherwise(1)
    dealt = stage(members.join(hubs, "variant").select("variant", "fp", "hub", near.alias("rest")), "dealt")
    with_hub = dealt.where((F.col("rest") == 0) & (F.col("fp") != F.col("hub"))).select(F.col("fp").alias("a"), F.col("hub").alias("b"))
    blocks = lambda part: F.ceil(F.count(F.when(F.col("rest") == part, 1)) / params.variant_rows).cast("int")
    totals = dealt.groupBy("variant").agg(blocks(1).alias("n_rest"), blocks(0).alias("n_near")).where("n_rest > 0")
    # Blocks of the rest come first: 0 to n_rest - 1. They meet each other and those of the near ones.
    n, first = F.when(F.col("rest") == 1, F.col("n_rest")).otherwise(F.col("n_near")), F.when(F.col("rest") == 1, 0).otherwise(F.col("n_rest"))
    block = (first + F.pmod(F.xxhash64("fp"), n)).cast("int")
    last = F.when(F.col("rest") == 1, F.col("n_rest") + F.col("n_near")).otherwise(F.col("n_rest")) - 1
    met = dealt.join(totals, "variant").select("variant", "fp", block.alias("block"), F.explode(F.sequence(F.lit(0), last.cast("int"))).alias("other"))
    pairs = met.select(
        "variant",
        F.least("block", "other").alias("low"),
        F.greatest("block", "other").alias("high"),
        "fp",
        (F.col("block") > F.col("other")).alias("second"),
    )
    left = pairs.groupBy("variant", "low", "high").applyInArrow(compare_blocks(params), "a long, b long")
    return with_hub.union(left)


def links(classes: DataFrame, params: Params) -> DataFrame:
    """``a, b``: links of ``fp, n_docs`` that connect what is connected."""
    rows = variants(classes, params)
    sizes = rows.groupBy("variant").agg(F.count("*").alias("size"))
    large = stage(sizes.where(F.col("size") > params.variant_rows).select("variant"), "large")
    small = rows.join(large, "variant", "left_anti").select("variant", "fp")
    in_small = small.repartition("variant").sortWithinPartitions("variant").mapInArrow(compare_sorted(params), "a long, b long")
    return stage(in_small.union(in_large_variants(rows, large, params)).distinct(), "links")


def find_near_duplicates(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, fp, component_id``.

    ``component_id`` is the smallest id of all documents connected with this one, itself
    included; null ids are no smallest id, so it is null only where all ids are. Null, empty
    and blank texts have the fingerprint zero and link like others. Rows of a repeated id are
    rows like others. Further columns are left alone. No rows give no rows.
    """
    found = stage(fingerprints(docs, params), "fingerprints")
    counted = found.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_docs"))
    classes = stage(counted, "classes")
    roots = components(links(classes.select("fp", "n_docs"), params)).select(F.col("node").alias("fp"), "root")
    rooted = classes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id")
    return found.join(named, "fp").select("doc_id", "fp", "component_id")


def report(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
