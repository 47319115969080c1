"""Nearest neighbours by inner product with a hash-prefix forest.

Each tree gives a vector a long hash string: the signs of its products with the tree's
random hyperplanes, taken after the vectors are lifted by one coordinate to equal length,
so that largest inner products become smallest angles. The sorted strings of a tree, in one
array, are its prefix tree: all strings with a common prefix stand together. A query
descends to its longest matching prefix in every tree, then all trees ascend together, one
bit at a time. Whenever they hold half as many entries again as at the last look, the rows
that are new are scored exactly; the ascent ends with looks that change nothing among the
nearest, or with all rows. So the work follows the data: tight groups end after a few per
cent of the rows, vectors without any neighbourhoods go on to most of them.

Rows are dealt into blocks by a hash of their id, each with a forest of its own; queries,
in blocks too, visit all of them, and the nearest of all blocks are merged.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packwright.session import stage


@dataclass(frozen=True)
class Params:
    """A query stops ascending in a block when ``calm`` looks in a row, each at ``growth``
    times the entries of the one before, leave the scores of its ``k`` nearest as they were.
    """

    k: int = 20
    trees: int = 64
    bits: int = 24
    growth: float = 1.5
    calm: int = 1
    block_rows: int = 20_000
    block_queries: int = 2_000
    seed: int = 97


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, vector``: finite vectors, not null or zero.

    A null id takes no part; rows that repeat an id count once, with the least vector.
    Vectors of different lengths have no inner product, so each length is searched by itself.
    """
    vector = F.col("embedding").cast("array<double>")
    sound = vectors.select("vec_id", vector.alias("vector")).where(
        F.col("vec_id").isNotNull()
        & (F.size("vector") > 0)
        & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("vector", lambda x: x != 0)
    )
    return sound.groupBy("vec_id").agg(F.min("vector").alias("vector"))


def forest_codes(params: Params, longest: float, lifted: bool):
    """A function of batches (vec_id, vector) that appends the hash string of every tree.

    Rows are lifted to the length of the longest; queries stay where they are, so their
    angle to a lifted row depends on the inner product alone.
    """

    def encode_alike(batch, planes):
        n = len(batch)
        x = batch.column(1).flatten().to_numpy().reshape(n, -1)
        lift = np.sqrt(np.maximum(longest - (x * x).sum(axis=1), 0.0)) if lifted else np.zeros(n)
        signs = (np.column_stack([x, lift]) @ planes > 0).reshape(n, params.trees, params.bits)
        codes = (signs.astype(np.int64) << np.arange(params.bits)[::-1]).sum(axis=2).astype(np.int32)
        offsets = pa.array(np.arange(n + 1, dtype=np.int32) * params.trees)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.ListArray.from_arrays(offsets, pa.array(codes.ravel()))],
            names=["vec_id", "vector", "codes"],
        )

    def encode(batches):
        planes = {}
        for batch in batches:
            lengths = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            for length in np.unique(lengths).tolist():
                if length not in planes:
                    draw = np.random.default_rng(params.seed)
                    planes[length] = draw.standard_normal((length + 1, params.trees * params.bits))
                yield encode_alike(batch.filter(pa.array(lengths == length)), planes[length])

    return encode


def build_index(vectors: DataFrame, every: int, params: Params) -> tuple[DataFrame, DataFrame]:
    """``vec_id, vector, codes`` of every usable row, and of the queries; written."""
    rows = stage(usable(vectors), "vectors")
    squared = F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + x * x)
    longest = rows.agg(F.max(squared)).head()[0] or 0.0
    schema = "vec_id long, vector array<double>, codes array<int>"
    queries = rows.where(F.col("vec_id") % every == 0)
    return (
        stage(rows.mapInArrow(forest_codes(params, longest, True), schema), "forest"),
        stage(queries.mapInArrow(forest_codes(params, longest, False), schema), "queries"),
    )


def entries_at(sorted_codes: np.ndarray, codes: np.ndarray, depth: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Where strings with the first ``depth`` bits of each code begin and stop."""
    low = codes >> (bits - depth) << (bits - depth)
    return np.searchsorted(sorted_codes, low), np.searchsorted(sorted_codes, low + (1 << (bits - depth)))


def search_block(params: Params):
    """A function of one block of rows and one of queries, all vectors of one length, to each
    query's nearest in it.

    ``scored`` is the number of rows whose product with the query was taken.
    """

    def ascend(own: int, query, rows, row_ids, trees, begin, stop) -> tuple[np.ndarray, np.ndarray, int]:
        """The nearest rows of one query, their scores, and how many were scored; ``begin`` and
        ``stop`` are its ranges by tree and number of bits that it has ascended."""
        held = row_ids == own
        met, products = [], []
        last, calm, n_scored, nearest = 0, 0, 0, np.zeros(0)
        low = high = np.zeros(len(trees), dtype=np.int32)
        entries = (stop - begin).sum(axis=0)
        for risen in range(params.bits + 1):
            top = risen == params.bits
            if not top and (entries[risen] <= len(trees) or entries[risen] < params.growth * last):
                continue
            before = held.copy()
            if top:
                held[:] = True
            else:
                # Only what the ranges have grown by, on both sides.
                grown = [tree[i:j] for tree, i, j in zip(trees, begin[:, risen], low if last else stop[:, risen])]
                if last:
                    grown += [tree[i:j] for tree, i, j in zip(trees, high, stop[:, risen])]
                held[np.concatenate(grown)] = True
            last, low, high = entries[risen], begin[:, risen], stop[:, risen]
            new = np.flatnonzero(held & ~before)
            met.append(new)
            products.append(rows[new] @ query)
            n_scored += len(new)
            known, nearest = nearest, np.concatenate([nearest, products[-1]])
            if len(nearest) > params.k:
                nearest = np.partition(nearest, -params.k)[-params.k :]
            nearest = np.sort(nearest)
            calm = calm + 1 if len(known) == params.k and np.array_equal(known, nearest) else 0
            if calm >= params.calm:
                break
        found, rough = np.concatenate(met), np.concatenate(products)
        if n_scored > params.k:
            # Products of a matrix may differ in the last bits between equal rows.
            found = found[rough >= nearest[0] - 1e-9 * max(1.0, abs(nearest[0]))]
        scores = (rows[found] * query).sum(axis=1)
        best = np.lexsort((row_ids[found], -scores))[: params.k]
        return row_ids[found][best], scores[best], n_scored

    def search(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        n_rows = len(asks)
        ids = table.column("vec_id").to_numpy()
        x = table.column("vector").combine_chunks().flatten().to_numpy().reshape(n_rows, -1)
        codes = table.column("codes").combine_chunks().flatten().to_numpy().astype(np.int64).reshape(n_rows, -1)
        row_ids, rows, row_codes = ids[~asks], np.ascontiguousarray(x[~asks]), codes[~asks]
        query_ids, queries, query_codes = ids[asks], x[asks], codes[asks]
        out: list[tuple[np.ndarray, ...]] = []
        if len(row_ids) and len(query_ids):
            order = np.argsort(row_codes, axis=0, kind="stable")
            arrays = np.ascontiguousarray(np.take_along_axis(row_codes, order, axis=0).T)
            trees = np.ascontiguousarray(order.T.astype(np.int32))
            shape = (params.trees, len(query_ids), params.bits + 1)
            begin, stop = np.empty(shape, dtype=np.int32), np.empty(shape, dtype=np.int32)
            for t in range(params.trees):
                for risen in range(params.bits + 1):
                    ranges = entries_at(arrays[t], query_codes[:, t], params.bits - risen, params.bits)
                    begin[t, :, risen], stop[t, :, risen] = ranges
            for i, own in enumerate(query_ids):
                near, scores, n_scored = ascend(own, queries[i], rows, row_ids, trees, begin[:, i], stop[:, i])
                out.append((np.full(len(near), own), near, scores, np.full(len(near), n_scored)))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 4
        names = {"query_id": np.int64, "vec_id": np.int64, "score": np.float64, "scored": np.int64}
        return pa.table({name: column.astype(kind) for (name, kind), column in zip(names.items(), columns)})

    return search


def nearest(vectors: DataFrame, every: int = 20, params: Params = Params()) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each id divisible by ``every``, its nearest.

    Largest inner product first, equal ones by id; the query's own row is left out. All
    rows as long as the query are returned where there are fewer than ``k``; without usable
    rows, none.
    """
    index, queries = build_index(vectors, every, params)
    n_rows, n_queries = index.count(), queries.count()
    row_blocks = max(1, -(-n_rows // params.block_rows))
    query_blocks = max(1, -(-n_queries // params.block_queries))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    columns = ["vec_id", "vector", "codes"]
    visited = index.select(*columns, F.lit(False).alias("asks"), dealt(row_blocks).alias("row_block"), numbers(query_blocks).alias("query_block"))
    visiting = queries.select(*columns, F.lit(True).alias("asks"), numbers(row_blocks).alias("row_block"), dealt(query_blocks).alias("query_block"))
    found = (
        visited.unionByName(visiting)
        .groupBy("row_block", "query_block", F.size("vector"))
        .applyInArrow(search_block(params), "query_id long, vec_id long, score double, scored long")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score")
        .where(F.col("rank") <= params.k)
    )
