"""Line dedup by a suffix array over line ids, on DataFrame functions only.

All documents, in order of their key, are one sequence of line ids. Prefix doubling ranks
the suffixes by their first 1, 2, 4, ... lines: a round sorts the pairs of the ranks at a
line and 2^k lines further on. Suffixes that share their first lines with no other leave.
A class of equal ranks is an interval of the suffix array whose longest common prefix
is at least that deep, and a run of any length is named by the ranks of the two
(overlapping) powers of two that cover it.

A repeated run counts from ``least_chars`` characters on. For each line the shortest run of
that size from it, and the shortest up to it, decide: every line of a longer repeated run
lies in one of these within the run. So suffixes are sorted as deep as such runs are long,
and sorting deeper would delete nothing else. Later copies of repeated runs are deleted;
the first, in order of (doc_id, place), stays.

Except that copies may overlap in one document: then lines of the first copy that are also
in a later one go, and repeats in a row are cut down to one period (equal lines to one
line). SQL defines it so.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packwright.session import stage

KEY = ["doc_id", "digest"]


@dataclass(frozen=True)
class Params:
    least_chars: int = 120


def text_key(text: Column) -> Column:
    """Tells texts of one id apart; rows with the same id and text are one document."""
    return F.xxhash64(text)


def line_table(docs: DataFrame) -> DataFrame:
    """``doc_id, digest, pos, a, b, chars``: a 96-bit id and the length of every line."""
    lines = docs.where(F.col("text").isNotNull()).select(
        "doc_id", text_key(F.col("text")).alias("digest"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")
    )
    return lines.select(
        *KEY, "pos", F.xxhash64("line").alias("a"), F.hash("line").alias("b"), F.length("line").alias("chars")
    )


def ranked(classes: DataFrame, *order: str) -> DataFrame:
    """Number the classes in their order; written, so the numbers hold when a task is run again."""
    return stage(classes.orderBy(*order).select(*order, F.monotonically_increasing_id().alias("rank")), "ranks")


def repeated_lines(lines: DataFrame) -> DataFrame:
    """``doc_id, digest, pos, chars, rank`` of lines that are there more than once."""
    classes = lines.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    rank = ranked(classes, "a", "b")
    return lines.join(rank, ["a", "b"]).select(*KEY, "pos", "chars", "rank").dropDuplicates([*KEY, "pos"])


def double(suffixes: DataFrame, step: int) -> DataFrame:
    """Ranks by twice as many lines, of suffixes that share them with another."""
    further = Window.partitionBy(*KEY).orderBy("pos").rangeBetween(step, step)
    pairs = suffixes.select(*KEY, "pos", F.col("rank").alias("here"), F.first("rank").over(further).alias("there"))
    pairs = pairs.where(F.col("there").isNotNull())
    classes = pairs.groupBy("here", "there").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    return pairs.join(ranked(classes, "here", "there"), ["here", "there"]).select(*KEY, "pos", "rank")


def shortest_runs(lines: DataFrame, least_chars: int) -> DataFrame:
    """``doc_id, digest, begin, stop``: from and up to each line, the shortest run of enough characters.

    Only lines that follow each other without a gap are in a run.
    """
    by_doc = Window.partitionBy(*KEY).orderBy("pos")
    islands = lines.select(*KEY, "pos", "chars", (F.col("pos") - F.row_number().over(by_doc)).alias("island"))
    island = [*KEY, "island"]
    along = Window.partitionBy(*island).orderBy("pos")
    borders = islands.select(
        *island,
        "pos",
        "chars",
        (F.sum("chars").over(along) - F.col("chars")).alias("before"),
        F.lead("pos").over(along).isNull().alias("last"),
    )
    # A border stands before each line, and behind the last.
    end = F.when(F.col("last"), F.struct((F.col("pos") + 1).alias("at"), (F.col("before") + F.col("chars")).alias("sum")))
    here = F.struct(F.col("pos").alias("at"), F.col("before").alias("sum"))
    borders = borders.select(*island, F.explode(F.array_compact(F.array(here, end))).alias("border"))
    at, total = F.col("border.at"), F.col("border.sum")
    looked = F.array(
        F.struct(total.alias("value"), F.lit(0).alias("asks"), at.alias("at"), F.lit(1).alias("way")),
        F.struct((total + least_chars).alias("value"), F.lit(1).alias("asks"), at.alias("at"), F.lit(1).alias("way")),
        F.struct((-total).alias("value"), F.lit(0).alias("asks"), (-at).alias("at"), F.lit(-1).alias("way")),
        F.struct((least_chars - total).alias("value"), F.lit(1).alias("asks"), (-at).alias("at"), F.lit(-1).alias("way")),
    )
    rows = borders.select(*island, F.inline(looked))
    # From high values down, the last border passed is the nearest one far enough.
    nearest = F.last(F.when(F.col("asks") == 0, F.col("at")), ignorenulls=True).over(
        Window.partitionBy(*island, "way")
        .orderBy(F.desc("value"), "asks", F.desc("at"))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    found = rows.select(*KEY, "asks", "at", "way", nearest.alias("other"))
    found = found.where((F.col("asks") == 1) & F.col("other").isNotNull())
    first = F.when(F.col("way") == 1, F.col("at")).otherwise(-F.col("other"))
    stop = F.when(F.col("way") == 1, F.col("other")).otherwise(-F.col("at"))
    return found.select(*KEY, first.alias("begin"), stop.alias("stop")).distinct()


def later_copies(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """``doc_id, digest, begin, stop``: maximal stretches of lines to delete."""
    suffixes = stage(repeated_lines(stage(line_table(docs), "lines")), "suffixes")
    runs = stage(
        shortest_runs(suffixes, params.least_chars)
        .select("*", (F.col("stop") - F.col("begin")).alias("n"))
        .select("*", F.floor(F.log2("n")).cast("int").alias("level")),
        "line-runs",
    )
    deepest = runs.agg(F.max("level")).head()[0]
    levels = suffixes.select(*KEY, "pos", "rank", F.lit(0).alias("level"))
    for level in range(1, (deepest or 0) + 1):
        suffixes = stage(double(suffixes, 1 << (level - 1)), "suffixes")
        levels = levels.unionByName(suffixes.select(*KEY, "pos", "rank", F.lit(level).alias("level")))

    def named(rows: DataFrame, at: str, name: str) -> DataFrame:
        ranks = levels.select(
            F.col("doc_id").alias("r_id"), F.col("digest").alias("r_digest"), F.col("pos").alias("r_pos"),
            F.col("level").alias("r_level"), F.col("rank").alias(name),
        )
        same = (
            F.col("doc_id").eqNullSafe(F.col("r_id"))
            & (F.col("digest") == F.col("r_digest"))
            & (F.col(at) == F.col("r_pos"))
            & (F.col("level") == F.col("r_level"))
        )
        return rows.join(ranks, same).drop("r_id", "r_digest", "r_pos", "r_level")

    tail = (F.col("stop") - F.pow(F.lit(2.0), F.col("level")).cast("int")).alias("tail")
    known = named(named(runs.select("*", tail), "begin", "head_rank"), "tail", "tail_rank")
    name = ["n", "head_rank", "tail_rank"]
    place = F.struct(*KEY, "begin")
    firsts = known.groupBy(*name).agg(F.min(place).alias("first"))
    later = known.join(firsts, name).where(place != F.col("first"))
    in_order = Window.partitionBy(*KEY).orderBy("begin", "stop")
    reached = F.max("stop").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    opened = later.select(*KEY, "begin", "stop", F.coalesce(F.col("begin") > reached, F.lit(True)).cast("int").alias("opens"))
    stretch = opened.select("*", F.sum("opens").over(in_order.rowsBetween(Window.unboundedPreceding, 0)).alias("stretch"))
    return stretch.groupBy(*KEY, "stretch").agg(F.min("begin").alias("begin"), F.max("stop").alias("stop")).drop("stretch")


def dedup_lines(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """All columns of ``docs``, with ``text`` less its later copies, and ``n_lines``, ``n_removed``.

    A null text stays null with no lines, an empty one is one empty line. Rows with the
    same id and text are one document and get the same result; a null id comes before
    all others. A document of nothing but later copies is left with an empty text. A
    column of ``docs`` named as one of the two counts is replaced.
    """
    removed = (
        later_copies(docs, params)
        .groupBy(F.col("doc_id").alias("cut_id"), F.col("digest").alias("cut_digest"))
        .agg(F.array_sort(F.collect_list(F.struct("begin", "stop"))).alias("cuts"))
    )
    same = F.col("docs.doc_id").eqNullSafe(F.col("cut_id")) & (text_key(F.col("docs.text")) == F.col("cut_digest"))
    packed = docs.alias("docs").join(removed, same, "left").select(F.struct("docs.*").alias("row"), "cuts")
    lines = F.split("row.text", "\n", -1)
    begins = F.transform("cuts", lambda c: c["begin"])
    stops = F.transform("cuts", lambda c: c["stop"])
    kept = F.flatten(
        F.zip_with(
            F.concat(F.array(F.lit(0)), stops),
            F.concat(begins, F.array(F.size(lines))),
            lambda a, b: F.slice(lines, a + 1, b - a),
        )
    )
    gone = F.aggregate("cuts", F.lit(0).cast("long"), lambda acc, c: acc + (c["stop"] - c["begin"]))
    made = F.struct(
        F.when(F.col("cuts").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n")).alias("text"),
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(gone, F.lit(0)).cast("long").alias("n_removed"),
    )
    # Columns of the documents get their names back last: any of them may be called as one here.
    others = [F.col("row")[c].alias(c) for c in docs.columns if c not in ("text", "n_lines", "n_removed")]
    return packed.select("row", made.alias("made")).select(*others, F.col("made")["text"].alias("text"), F.col("made")["n_lines"].alias("n_lines"), F.col("made")["n_removed"].alias("n_removed"))
