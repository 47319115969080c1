"""Near-duplicate documents by min-max hashing.

Every permutation of the shingles gives two signature values, its least and its greatest,
so a signature needs half as many hash evaluations as values. Bands of the signature put
documents into buckets. Equal shingle sets are one class and meet before anything else.

Pairs are confirmed on full sets and without emitting pairs: a bucket sends its members to
the most central of them (the hub), and the members of a hub are compared with it. Those
that link with it are connected; only the others then meet all members, inside tasks, as
products of incidence matrices over blocks of a bounded number of shingles. A task returns
a spanning star per group it finds, not its pairs.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packwright.llm.grams import bitmap, map_texts
from packwright.llm.words import BLANK_SEPARATED, FOLD, mix, runs, signed, slices, split_words
from packwright.session import stage

# Bits of the filter that lets texts of candidates through; see the bitmap of grams.py.
FILTER_BITS = 1 << 23


@dataclass(frozen=True)
class Params:
    """Pairs link at 100 * intersection >= percent * union.

    A permutation's least and greatest agree for sets of c common shingles among u with
    probability c (c - 1) / (u (u - 1)), which for small sets is less than the square of
    their similarity. At similarity 0.75, 64 bands of 4 values miss 4 against 3 shingles
    with probability 1e-8, 8 against 6 with 4e-10, and large sets with 3e-11.
    ``block_shingles`` and ``block_docs`` bound what a task compares at once.
    """

    words: int = 5
    percent: int = 75
    bands: int = 64
    rows: int = 4
    block_shingles: int = 400_000
    block_docs: int = 1_500
    seed: int = 20240229


def shingle_sets(texts: list[bytes | None], k: int) -> list[np.ndarray]:
    """The distinct shingles of each text, sorted; all words as one where there are fewer."""
    words = split_words(texts, BLANK_SEPARATED)
    hashes, starts = runs(words, k)
    counts = np.maximum(np.diff(words.first) - k + 1, 0)
    ends = np.cumsum(counts)
    out = []
    for i, n in enumerate(np.diff(words.first).tolist()):
        if n >= k:
            out.append(np.unique(hashes[ends[i] - counts[i] : ends[i]]))
        elif n:
            whole = np.full(1, 977 + n, dtype=np.uint64)
            for h in words.hash[words.first[i] : words.first[i + 1]]:
                whole = mix(whole * np.uint64(FOLD) + h)
            out.append(whole)
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def class_of(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes(), seed=len(shingles))


def permutations(params: Params) -> tuple[np.ndarray, np.ndarray]:
    n = params.bands * params.rows // 2
    numbers = np.random.default_rng(params.seed).integers(0, 1 << 63, size=(2, n), dtype=np.uint64)
    return numbers[0] * np.uint64(2) + np.uint64(1), numbers[1]


def band_keys(sets: list[np.ndarray], params: Params) -> np.ndarray:
    """One key per band of each set, none empty: hashes of its min and max values."""
    flat = mix(np.concatenate(sets))
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    values = np.empty((len(sets), params.bands * params.rows), dtype=np.uint64)
    for i, (a, b) in enumerate(zip(*permutations(params))):
        permuted = flat * a + b
        values[:, 2 * i] = np.minimum.reduceat(permuted, starts)
        values[:, 2 * i + 1] = np.maximum.reduceat(permuted, starts)
    banded = values.reshape(len(sets), params.bands, params.rows)
    keys = np.broadcast_to(np.arange(params.bands, dtype=np.uint64), banded.shape[:2])
    for i in range(params.rows):
        keys = mix(keys * np.uint64(FOLD) + banded[:, :, i])
    return keys


def sketches(docs: DataFrame, params: Params) -> DataFrame:
    """``doc_id, class, n_shingles, bands``; an empty set has neither class nor bands."""
    id_type = dict(docs.dtypes)["doc_id"]

    def sketch(ids: pa.Array, texts: list[bytes | None]) -> Iterator[pa.RecordBatch]:
        sets = shingle_sets(texts, params.words)
        full = [i for i, s in enumerate(sets) if len(s)]
        classes, bands = [None] * len(sets), [None] * len(sets)
        if full:
            digests = signed(np.array([class_of(sets[i]) for i in full], dtype=np.uint64)).tolist()
            for i, digest, keys in zip(full, digests, signed(band_keys([sets[i] for i in full], params))):
                classes[i], bands[i] = digest, keys
        yield pa.RecordBatch.from_arrays(
            [
                ids,
                pa.array(classes, pa.int64()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array(bands, pa.list_(pa.int64())),
            ],
            names=["doc_id", "class", "n_shingles", "bands"],
        )

    return map_texts(
        docs.select("doc_id", "text"), sketch, f"doc_id {id_type}, class long, n_shingles long, bands array<long>"
    )


def hub_members(classes: DataFrame) -> DataFrame:
    """``hub, class, n_shingles``: who has to be compared with whom.

    The hub of a bucket is the member that meets most others over all its buckets.
    """
    rows = classes.select("class", "n_shingles", F.explode("bands").alias("bucket"))
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("size")).where(F.col("size") > 1)
    met = stage(rows.join(sizes, "bucket"), "buckets")
    central = met.groupBy("class").agg(F.sum("size").alias("meets"))
    hubs = (
        met.join(central, "class")
        .groupBy("bucket")
        .agg(F.max(F.struct("meets", "class")).alias("most"))
        .select("bucket", F.col("most.class").alias("hub"))
    )
    return met.join(hubs, "bucket").select("hub", "class", "n_shingles").distinct()


def candidate_texts(docs: DataFrame, wanted: DataFrame, params: Params) -> DataFrame:
    """``class, text`` of one document of each wanted class (``class, rep``).

    A bitmap of fixed size over the representatives' ids keeps most other texts where they
    are; the join decides.
    """
    place = F.pmod(F.xxhash64("rep"), F.lit(FILTER_BITS)).cast("int")
    flags = bitmap(wanted.select(place.alias("place")), FILTER_BITS)
    shared = docs.sparkSession.sparkContext.broadcast(flags)
    id_type = dict(docs.dtypes)["doc_id"]

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(2).to_numpy()
            there = (shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            picked = batch.filter(pa.array(there))
            texts = picked.column(1).to_pylist()
            for begin, stop in slices(texts):
                sets = shingle_sets(texts[begin:stop], params.words)
                classes = [int(signed(np.array([class_of(s)], dtype=np.uint64))[0]) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [picked.column(0).slice(begin, stop - begin), pa.array(classes, pa.int64()), picked.column(1).slice(begin, stop - begin)],
                    names=["doc_id", "class", "text"],
                )

    placed = docs.select(
        "doc_id",
        F.col("text").cast("binary").alias("text"),
        F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)).cast("long").alias("place"),
    )
    found = placed.mapInArrow(pick, f"doc_id {id_type}, class long, text binary").alias("found")
    same = (F.col("found.class") == F.col("wanted.class")) & F.col("found.doc_id").eqNullSafe(F.col("wanted.rep"))
    joined = found.join(wanted.alias("wanted"), same).select("found.class", "found.text")
    return joined.dropDuplicates(["class"])


def linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Which sets of ``left`` link with which of ``right``, as a matrix of flags."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    column, owner = number[column[keep]], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    n_columns = int(column[-1]) + 1 if len(column) else 0
    common = np.zeros((len(left), len(right)), dtype=np.float32)
    width = 1024
    for begin in range(0, n_columns, width):
        a, b = np.searchsorted(column, (begin, begin + width))
        there = np.zeros((len(sets), width), dtype=np.float32)
        there[owner[a:b], column[a:b] - begin] = 1.0
        common += there[left] @ there[right].T
    inter = np.rint(common).astype(np.int64)
    union = sizes[left][:, None] + sizes[right][None, :] - inter
    return 100 * inter >= percent * union


def stars(flags: np.ndarray) -> np.ndarray:
    """For a symmetric matrix of links, the least member each member is connected with."""
    label = np.arange(len(flags))
    flags = flags | np.eye(len(flags), dtype=bool)
    while True:
        least = np.where(flags, label[None, :], len(flags)).min(axis=1)
        least = np.minimum(least, least[least])
        if (least == label).all():
            return label
        label = least


def compare_blocks(params: Params):
    """A function of the rows of one pair of blocks to a few links ``a, b`` that connect them."""

    def compare(table: pa.Table) -> pa.Table:
        classes = table.column("class").to_numpy()
        second = table.column("second").to_numpy(zero_copy_only=False).astype(bool)
        texts = table.column("text").to_pylist()
        sets = []
        for begin, stop in slices(texts):
            sets += shingle_sets(texts[begin:stop], params.words)
        n = len(sets)
        flags = np.zeros((n, n), dtype=bool)
        if second.any() and not second.all():
            left, right = np.flatnonzero(~second), np.flatnonzero(second)
            between = linked(sets, left, right, params.percent)
            flags[np.ix_(left, right)] = between
            flags[np.ix_(right, left)] = between.T
        elif not second.any():
            everyone = np.arange(n)
            flags = linked(sets, everyone, everyone, params.percent)
        label = stars(flags)
        joined = np.flatnonzero(label != np.arange(n))
        return pa.table({"a": classes[joined], "b": classes[label[joined]]})

    return compare


def compare_hub(params: Params):
    """A function of a hub (not ``second``) and some of its members to those that link with it."""

    def compare(table: pa.Table) -> pa.Table:
        classes = table.column("class").to_numpy()
        second = table.column("second").to_numpy(zero_copy_only=False).astype(bool)
        texts = table.column("text").to_pylist()
        sets = []
        for begin, stop in slices(texts):
            sets += shingle_sets(texts[begin:stop], params.words)
        hub, others = np.flatnonzero(~second), np.flatnonzero(second)
        near = others[linked(sets, hub, others, params.percent).any(axis=0)]
        return pa.table({"hub": np.repeat(classes[hub], len(near)), "class": classes[near]})

    return compare


def blocks_of(rows: DataFrame, name: str, params: Params) -> DataFrame:
    """``hub`` and in how many blocks its rows go."""
    most = F.greatest(F.sum("n_shingles") / params.block_shingles, F.count("*") / params.block_docs)
    return rows.groupBy("hub").agg(F.ceil(most).cast("int").alias(name))


def with_hub(members: DataFrame, params: Params) -> DataFrame:
    """``pair, class, second``: blocks of members other than the hub, each with the hub."""
    others = members.where(F.col("class") != F.col("hub"))
    totals = blocks_of(others, "blocks", params)
    dealt = others.join(totals, "hub").select("hub", "class", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int").alias("block"))
    hubs = totals.select("hub", F.col("hub").alias("class"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    rows = dealt.withColumn("second", F.lit(True)).unionByName(hubs.withColumn("second", F.lit(False)))
    return rows.select(F.xxhash64("hub", "block").alias("pair"), "class", "second")


def without_hub(members: DataFrame, near: DataFrame, params: Params) -> DataFrame:
    """``pair, class, second``: pairs of blocks of what is left to compare after the hubs.

    Members that link with their hub (``near``) are connected already. Only the rest meets
    all members, so blocks of near members come first and pair with those of the rest.
    """
    flagged = near.select("hub", "class", F.lit(True).alias("linked"))
    others = members.where(F.col("class") != F.col("hub")).join(flagged, ["hub", "class"], "left")
    close, rest = others.where(F.col("linked")), others.where(F.col("linked").isNull())
    totals = blocks_of(rest, "rest_blocks", params).join(blocks_of(close, "near_blocks", params), "hub", "left")
    totals = totals.select("hub", "rest_blocks", F.coalesce("near_blocks", F.lit(0)).alias("near_blocks"))
    place = lambda n: F.pmod(F.xxhash64("class"), F.col(n)).cast("int")
    first, last = F.col("near_blocks"), F.col("near_blocks") + F.col("rest_blocks") - 1
    of_near = close.join(totals, "hub").select("hub", "class", place("near_blocks").alias("block"), F.explode(F.sequence(first, last)).alias("other"))
    of_rest = rest.join(totals, "hub").select(
        "hub", "class", (first + place("rest_blocks")).alias("block"), F.explode(F.sequence(F.lit(0), last)).alias("other")
    )
    return of_near.unionByName(of_rest).select(
        F.xxhash64("hub", F.least("block", "other"), F.greatest("block", "other")).alias("pair"),
        "class",
        (F.col("block") > F.col("other")).alias("second"),
    )


def links(members: DataFrame, texts: DataFrame, params: Params) -> DataFrame:
    """``a, b``: links that connect what is connected. Blocks are dealt by a hash of the class."""
    texts = stage(texts, "texts")
    rows = with_hub(members, params).join(texts, "class").select("pair", "class", "second", "text")
    near = stage(rows.groupBy("pair").applyInArrow(compare_hub(params), "hub long, class long"), "near")
    rows = without_hub(members, near, params).join(texts, "class").select("pair", "class", "second", "text")
    left = rows.groupBy("pair").applyInArrow(compare_blocks(params), "a long, b long")
    return near.select(F.col("class").alias("a"), F.col("hub").alias("b")).union(left)


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the least node each node of ``a, b`` is connected with.

    Least labels of neighbours, then labels of labels, until nothing changes; every round
    is a written table.
    """
    both = stage(edges.union(edges.select("b", "a")).distinct(), "edges")
    state = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "roots")
    while True:
        near = both.join(state, both["b"] == state["node"]).groupBy("a").agg(F.min("root").alias("near"))
        lowered = state.join(near, state["node"] == near["a"]).select("node", F.least("root", "near").alias("root"))
        parent = state.select(F.col("node").alias("root"), F.col("root").alias("above"))
        following = stage(
            lowered.join(parent, "root", "left").select("node", F.least("root", F.coalesce("above", "root")).alias("root")),
            "roots",
        )
        old = state.select("node", F.col("root").alias("old"))
        if following.join(old, "node").where(F.col("root") != F.col("old")).isEmpty():
            return following
        state = following


def find_near_duplicates(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, digest, class, n_shingles, root, component_id, kept``.

    ``component_id`` is the smallest id of all documents connected with this one. A null
    or empty text has no shingles and is alone. Null ids never name a component unless it
    has no other; then it is null and its rows are kept. Rows of a repeated id are rows
    like others, so all rows that carry the smallest id are kept.
    """
    # The id travels with a hash of the text, which tells rows of one id apart.
    rows = docs.select(F.struct("doc_id", F.xxhash64("text").alias("digest")).alias("doc_id"), "text")
    sketched = stage(sketches(rows, params).select("doc_id.*", "class", "n_shingles", "bands"), "sketches")
    full = sketched.where(F.col("class").isNotNull())
    classes = full.groupBy("class").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands")
    )
    classes = stage(classes, "classes")
    members = stage(hub_members(classes), "members")
    wanted = members.select("class").distinct().join(classes.select("class", "rep"), "class")
    edges = links(members, candidate_texts(docs, wanted, params), params)
    roots = components(edges).select(F.col("node").alias("class"), "root")
    rooted = full.drop("bands").join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    alone = sketched.where(F.col("class").isNull()).drop("bands")
    alone = alone.withColumns({"root": F.lit(None).cast("long"), "component_id": F.col("doc_id")})
    grouped = rooted.join(least, "root").unionByName(alone)
    return grouped.select("*", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """The rows of ``docs``, all columns, that stay: one of each component.

    It is the one with the smallest id, of several such rows the one whose text has the
    least hash, and of equal rows one. Texts without words are alone and stay.
    """
    found = find_near_duplicates(docs, params).where("kept")
    grouped = found.where(F.col("root").isNotNull()).groupBy("root").agg(F.min(F.struct("doc_id", "digest")).alias("one"))
    alone = found.where(F.col("root").isNull()).select("doc_id", "digest")
    staying = grouped.select("one.*").union(alone).distinct().toDF("stay_id", "stay_digest")
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.xxhash64("text").alias("digest"))
    same = F.col("row.doc_id").eqNullSafe(F.col("stay_id")) & (F.col("digest") == F.col("stay_digest"))
    rows = keyed.join(staying, same).dropDuplicates(["stay_id", "stay_digest"])
    return rows.select("row.*")


def report(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_shingles", "component_id", "kept")
