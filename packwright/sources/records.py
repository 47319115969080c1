"""Reading record files, with schemas that are stated and never inferred."""

import re
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packwright.functions.keys import DATA_TYPES, TEXT_FILES, data_type_of, path_part
from packwright.session import stage

CHAT_SCHEMA = "conversations array<struct<`from`: string, `value`: string>>"
TEXT_SCHEMA = "markdown string"
EXAMPLE_SCHEMA = "token_ids array<int>, tgt_mask array<int>"


def read_chat_records(spark: SparkSession, paths: str | Sequence[str], extra: str = "") -> DataFrame:
    """One JSON object per line; ``extra`` adds fields to the schema."""
    schema = f"{extra}, {CHAT_SCHEMA}" if extra else CHAT_SCHEMA
    return spark.read.schema(schema).json(paths)


def chat_turns(records: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row per turn, in the order of the record."""
    turns = records.select(*keep, F.posexplode("conversations").alias("turn", "_t"))
    return turns.select(*keep, "turn", F.col("_t.from").alias("role"), F.col("_t.value").alias("text"))


def read_text_records(spark: SparkSession, paths: str | Sequence[str], extra: str = "") -> DataFrame:
    schema = f"{extra}, {TEXT_SCHEMA}" if extra else TEXT_SCHEMA
    return spark.read.schema(schema).json(paths).withColumnRenamed("markdown", "text")


def route(df: DataFrame, file_name: str, text_files: Sequence[str] = TEXT_FILES) -> DataFrame:
    return df.withColumn("data_type", data_type_of(F.col(file_name), tuple(text_files)))


def source_path() -> Column:
    """The file a row comes from; for a DataFrame straight from a file reader."""
    return F.col("_metadata.file_path")


# Where a row stands: the number of its file in order of paths, its split, its row there.
PLACE = ("file_no", "part_start", "row_in_part")


def _path_key(path: Column) -> Column:
    """Readers write the same path with one or with three slashes after the scheme."""
    return F.regexp_replace(path, "^([a-z0-9]+):/+", "$1:/")


def path_below(spark: SparkSession, paths: str) -> Column:
    """The file a row comes from, from the folder down that ``paths`` names before any pattern.

    The same files in another place have the same names.
    """
    fixed = re.split(r"[*?\[{]", paths, maxsplit=1)[0]
    folder = fixed if fixed == paths else fixed.rsplit("/", 1)[0] if "/" in fixed else "."
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    qualified = files.makeQualified(path)
    if folder == paths and files.exists(path) and files.getFileStatus(path).isFile():
        qualified = qualified.getParent()
    depth = len(re.sub("^([a-z0-9]+):/+", r"\1:/", qualified.toString()).rstrip("/").split("/"))
    parts = F.split(_path_key(source_path()), "/")
    return F.array_join(F.slice(parts, F.lit(depth + 1), F.size(parts)), "/")


def numbered_files(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``path_key, file_no``: files in order of their paths; only names are read."""
    files = spark.read.format("binaryFile").load(paths).select(_path_key(F.col("path")).alias("path_key"))
    numbers = files.distinct().orderBy("path_key").select("path_key", F.monotonically_increasing_id().alias("file_no"))
    return stage(numbers, "file-numbers")


def read_tokenized_files(
    spark: SparkSession, paths: str | Sequence[str], subset_from_end: int = 1
) -> tuple[DataFrame, DataFrame]:
    """Tokenized line files laid out as ``<data_type>/<subset file>``, with their place.

    Returns the examples, and a count of rows per folder that is no known data type. A
    line that is malformed, lacks a field or has a mask of another length is an error. If
    a subset is a folder of files, it is the second part of the path from the end.
    """
    schema = f"{EXAMPLE_SCHEMA}, _corrupt string"
    read = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_corrupt").json(paths).select(
        path_part(source_path(), subset_from_end + 1).alias("data_type"),
        path_part(source_path(), subset_from_end).alias("subset_name"),
        _path_key(source_path()).alias("path_key"),
        F.col("_metadata.file_block_start").alias("part_start"),
        F.monotonically_increasing_id().alias("row_in_part"),
        "token_ids",
        "tgt_mask",
        "_corrupt",
    )
    sound = F.col("_corrupt").isNull() & (F.size("token_ids") == F.size("tgt_mask"))
    problem = F.raise_error(F.concat(F.lit("not an example: a line of "), F.col("path_key"))).cast("array<int>")
    read = read.withColumn("token_ids", F.when(sound, F.col("token_ids")).otherwise(problem))
    read = read.join(numbered_files(spark, paths), "path_key").select(
        "data_type", "subset_name", *PLACE, "token_ids", "tgt_mask"
    )
    known = F.col("data_type").isin(*DATA_TYPES)
    rejected = read.where(~known).groupBy("data_type").agg(F.count("*").alias("n_rejected"))
    return read.where(known), rejected


def count_records(df: DataFrame, groups: Sequence[str]) -> DataFrame:
    return df.groupBy(*groups).agg(F.count("*").alias("n_records"))


def read_result_files(spark: SparkSession, folder: str | Sequence[str]) -> DataFrame:
    """Evaluation results, one document per row; absent ones are simply not there.

    A file is named ``eval_<model>_<suite>.json``, or ``eval_<suite>.json`` inside a model's
    folder. One folder is read with all folders below it, and a model's folder has its path
    below that one as its name (null for files of no model right in it). Of several folders
    each is a model's own, named by the last part of its path; two equal names are an error.
    """
    if isinstance(folder, str):
        below = F.regexp_extract(path_below(spark, folder), "^(?:(.*)/)?[^/]+$", 1)
        read = spark.read.text(folder, wholetext=True, pathGlobFilter="eval_*.json", recursiveFileLookup=True)
    else:
        names = [path.rstrip("/").rsplit("/", 1)[-1] for path in folder]
        if len(set(names)) < len(names):
            raise ValueError(f"two model folders of one name: {sorted(names)}")
        below = path_part(source_path(), 2)
        read = spark.read.text(list(folder), wholetext=True, pathGlobFilter="eval_*.json")
    name = path_part(source_path(), 1)
    named = r"^eval_(?:(.+)_)?([^_]+)\.json$"
    in_name = F.regexp_extract(name, named, 1)
    model = F.when(in_name != "", in_name).otherwise(below)
    return read.select(
        name.alias("file_name"),
        F.when(model != "", model).alias("model"),
        F.regexp_extract(name, named, 2).alias("suite"),
        F.col("value").alias("document"),
    )


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """``path`` of every file below a folder, and of every folder with a file in it.

    Only names are read. An empty or absent folder has no rows.
    """
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "path string")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    parts = F.split(F.substring("path", len(root) + 2, 1 << 30), "/")
    above = F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda n: F.concat(F.lit(root + "/"), F.array_join(F.slice(parts, F.lit(1), n), "/")),
    )
    return files.select(F.explode(above).alias("path")).distinct()
