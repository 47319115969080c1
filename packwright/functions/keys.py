"""Dotted keys, paths and result names."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keys that carry an ordinal, as in 'model.layers.7.mlp.weight'.
LAYER_PREFIX = "model.layers."
ORDINAL_FIELD = 3  # one-based place of the ordinal among the dotted fields

# Input files of plain text; every other file holds chats.
TEXT_FILES = ("textbooks.jsonl", "program_books.jsonl")
DATA_TYPES = ("chat", "text")


def has_prefix(key: Column, prefix: str = LAYER_PREFIX) -> Column:
    return key.startswith(prefix)


def key_ordinal(key: Column) -> Column:
    return F.element_at(F.split(key, r"\."), ORDINAL_FIELD).cast("bigint")


def with_ordinal(key: Column, ordinal: Column) -> Column:
    """The key with another ordinal in the same place."""
    fields = F.split(key, r"\.")
    head = F.slice(fields, 1, ORDINAL_FIELD - 1)
    tail = F.slice(fields, F.lit(ORDINAL_FIELD + 1), F.greatest(F.size(fields) - ORDINAL_FIELD, F.lit(0)))
    return F.array_join(F.concat(head, F.array(ordinal.cast("string")), tail), ".")


def data_type_of(file_name: Column, text_files: tuple[str, ...] = TEXT_FILES) -> Column:
    return F.when(file_name.isin(*text_files), F.lit("text")).otherwise(F.lit("chat"))


def path_part(path: Column, from_end: int) -> Column:
    """``from_end=1`` is the file name, ``2`` its folder."""
    return F.element_at(F.split(path, "/"), -from_end)


def result_name(path: Column, is_local: Column, suite: Column) -> Column:
    """File of a suite's results: inside a local folder, else named after the last path part."""
    return F.when(is_local, F.concat(path, F.lit("/eval_"), suite, F.lit(".json"))).otherwise(
        F.concat(F.lit("eval_"), path_part(path, 1), F.lit("_"), suite, F.lit(".json"))
    )


def checkpoint_ordinal(path: Column) -> Column:
    """N of a path that ends in ``ckpt_N``; null for any other path."""
    digits = F.regexp_extract(path, r"(?:^|/)ckpt_(\d+)$", 1)
    return F.when(digits != "", digits.cast("bigint"))
