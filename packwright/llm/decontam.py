"""Benchmark decontamination as a prefix-filtered set join.

A benchmark item is cut into windows; a window is the set of its shingles. Shingles are
ordered by how rare they are in all documents. Containment of a whole window needs every
shingle, so one prefix token, the rarest, is enough to find each document place that can
hold it: documents and windows are joined on that token alone. Length and position bounds
(the window has to begin and end inside the document) and the comparison of all its words
in place decide.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packwright.llm.grams import gram_counts, gram_rows, map_texts, sieve_of
from packwright.llm.words import ALPHANUMERIC, runs, signed, split_words
from packwright.session import stage


@dataclass(frozen=True)
class Params:
    window: int = 10
    shingle: int = 3


def windows_of(benchmark: DataFrame, params: Params) -> DataFrame:
    """``item_id, window, n, k, shingles``: all windows of all items.

    ``window`` has the n words with blanks between them. An item of fewer words than a
    window is one window, with shingles of all its words if those are fewer than a
    shingle; an item without words has none, and neither has one without an id.
    """
    id_type = dict(benchmark.dtypes)["item_id"]

    def cut(ids: pa.Array, texts: list[bytes | None]) -> Iterator[pa.RecordBatch]:
        words = split_words(texts, ALPHANUMERIC)
        items, spelled, sizes, ks, shingles = [], [], [], [], []
        by_size = {k: dict(zip(starts.tolist(), signed(hashes).tolist())) for k in range(1, params.shingle + 1) for hashes, starts in [runs(words, k)]}
        for item, (first, last) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist())):
            n = min(params.window, last - first)
            k = min(params.shingle, n)
            for begin in range(first, last - n + 1) if n else ():
                items.append(item)
                spelled.append(" ".join(words.text(begin, begin + n)))
                sizes.append(n)
                ks.append(k)
                shingles.append([by_size[k][at] for at in range(begin, begin + n - k + 1)])
        yield pa.RecordBatch.from_arrays(
            [
                ids.take(pa.array(np.array(items, dtype=np.int64))),
                pa.array(spelled, pa.string()),
                pa.array(sizes, pa.int64()),
                pa.array(ks, pa.int64()),
                pa.array(shingles, pa.list_(pa.int64())),
            ],
            names=["item_id", "window", "n", "k", "shingles"],
        )

    named = benchmark.where(F.col("item_id").isNotNull())
    return map_texts(
        named.select("item_id", "text"), cut, f"item_id {id_type}, window string, n long, k long, shingles array<long>"
    )


def prefixes(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """``window, n, hash, k, offset``: the rarest shingle of each window and where it stands."""
    tokens = windows.dropDuplicates(["window"]).select(
        "window", "n", "k", F.posexplode("shingles").alias("offset", "hash")
    )
    ranked = tokens.join(counts, "hash", "left").select("*", F.coalesce("n_docs_places", F.lit(0)).alias("places"))
    rarest = F.row_number().over(Window.partitionBy("window").orderBy("places", "hash", "offset"))
    return ranked.select("*", rarest.alias("rank")).where(F.col("rank") == 1).select("window", "n", "hash", "k", "offset")


def find_windows(docs: DataFrame, benchmark: DataFrame, params: Params = Params()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, window occurrences and item windows.

    ``(doc_id, digest, n_words, copies)``; ``(doc_id, digest, window, start, n)``;
    ``(item_id, window)``.
    """
    windows = stage(windows_of(benchmark, params), "windows")
    shingles = windows.select("k", F.explode("shingles").alias("hash")).distinct()
    counts = gram_counts(docs, sieve_of(shingles)).withColumnRenamed("n", "n_docs_places")
    tokens = stage(prefixes(windows, counts), "prefixes")
    rows = stage(
        gram_rows(docs, sieve_of(tokens), before=params.window - 1, after=params.window), "window-places"
    )
    documents = (
        rows.where(F.col("hash").isNull())
        .groupBy("doc_id", "digest")
        .agg(F.max("n_words").alias("n_words"), F.count("*").alias("copies"))
    )
    start = F.col("pos") - F.col("offset")
    held = F.slice("around", (start - F.col("from_word") + 1).cast("int"), F.col("n").cast("int"))
    occurrences = (
        rows.where(F.col("hash").isNotNull())
        .drop("k")
        .join(tokens.drop("k"), "hash")
        .where((start >= 0) & (start + F.col("n") <= F.col("n_words")))
        .where(F.array_join(F.when(start >= F.col("from_word"), held), " ") == F.col("window"))
        .select("doc_id", "digest", "window", start.alias("start"), "n")
        .distinct()
    )
    return documents, occurrences, windows.select("item_id", "window").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, params: Params = Params()) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_hit, items``.

    ``n_hit`` counts words inside any occurrence of a window; ``items`` are the ids, as
    strings in order, of items with an occurring window. Null and empty texts have no
    words; items with a null id are left out; rows with the same id and text are counted
    once and given back as often as they are there. An empty benchmark hits nothing.
    """
    documents, occurrences, item_windows = find_windows(docs, benchmark, params)
    key = ["doc_id", "digest"]
    covered = F.aggregate(
        F.array_sort(F.collect_set(F.struct("start", "n"))),
        F.struct(F.lit(0).cast("long").alias("words"), F.lit(0).cast("long").alias("upto")),
        lambda acc, w: F.struct(
            (acc["words"] + F.greatest(F.lit(0), w["start"] + w["n"] - F.greatest(w["start"], acc["upto"]))).alias("words"),
            F.greatest(acc["upto"], w["start"] + w["n"]).alias("upto"),
        ),
        lambda acc: acc["words"],
    )
    hit = occurrences.groupBy(*key).agg(covered.alias("n_hit"))
    items = (
        occurrences.select(*key, "window")
        .distinct()
        .join(item_windows, "window")
        .groupBy(*key)
        .agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    )
    same = lambda other: F.col("d.doc_id").eqNullSafe(F.col(f"{other}.doc_id")) & (
        F.col("d.digest") == F.col(f"{other}.digest")
    )
    joined = (
        documents.alias("d").join(hit.alias("h"), same("h"), "left").join(items.alias("i"), same("i"), "left")
    )
    return joined.select(
        "d.doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.explode(F.sequence(F.lit(1), "copies")).alias("copy"),
    ).drop("copy")


def clean(docs: DataFrame, benchmark: DataFrame, params: Params = Params()) -> DataFrame:
    """The rows of ``docs``, all columns, in which no window of the benchmark occurs."""
    keyed = docs.select(F.struct("doc_id", F.xxhash64("text").alias("digest")).alias("doc_id"), "text")
    _, occurrences, _ = find_windows(keyed, benchmark, params)
    hit = occurrences.select(F.col("doc_id.doc_id").alias("hit_id"), F.col("doc_id.digest").alias("hit_digest")).distinct()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.xxhash64("text").alias("digest"))
    same = F.col("row.doc_id").eqNullSafe(F.col("hit_id")) & (F.col("digest") == F.col("hit_digest"))
    return rows.join(hit, same, "left_anti").select("row.*")


def report(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
