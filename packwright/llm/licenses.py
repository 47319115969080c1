"""License scans by diagonal voting.

Rolling word k-grams of documents are joined with the places where they stand in a set of
templates. A match at document word p and template word t votes for the diagonal p - t.
Neighbouring diagonals of one template are merged (words put in or left out move the
diagonal), and a span counts if enough of the template's k-grams voted for it. Votes are
for equal words: the words behind equal hashes are compared.
"""

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packwright.llm.grams import gram_rows, sieve_of
from packwright.llm.notices import FULL_NOTICES
from packwright.llm.words import fold_hash, phrase_hash
from packwright.session import stage

# Phrases whose places are counted, and their labels.
BASE_PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# Beginnings of well-known notices, and labels of our own.
NOTICES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this "
    "software and associated documentation files": "mit",
    "redistribution and use in source and binary forms with or without modification are "
    "permitted provided that the following conditions are met": "bsd",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2.0",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
}


@dataclass(frozen=True)
class Params:
    """Beginnings of notices vote by ``notice_k`` words (all, if they have fewer), whole
    notices by ``full_k``.

    ``reach`` is how far apart diagonals may be to be merged, ``least`` the part of a
    notice's k-grams that has to vote for a span.
    """

    notice_k: int = 3
    full_k: int = 5
    reach: int = 3
    least: float = 0.6


def templates(params: Params = Params()) -> list[tuple[str, str, bool, int]]:
    """Words with single blanks between them, label, whether of the base, and k."""
    plain = lambda text: " ".join(re.findall("[0-9a-z]+", text.lower()))
    return (
        [(phrase, label, True, len(phrase.split())) for phrase, label in BASE_PHRASES.items()]
        + [(phrase, label, False, min(params.notice_k, len(phrase.split()))) for phrase, label in NOTICES.items()]
        + [(plain(text), label, False, params.full_k) for label, text in FULL_NOTICES.items()]
    )


def template_grams(spark: SparkSession, params: Params) -> DataFrame:
    """``template, label, base, total, k, offset, hash, gram``: of the fixed texts."""
    rows = []
    for template, (phrase, label, base, k) in enumerate(templates(params)):
        words, hashes = phrase_hash(phrase)
        total = len(words) - k + 1
        for offset in range(total):
            value = fold_hash(hashes, offset, k)
            value -= (value >> 63) << 64
            rows.append((template, label, base, total, k, offset, value, words[offset : offset + k]))
    return spark.createDataFrame(
        rows,
        "template int, label string, base boolean, total long, k long, offset long, hash long, gram array<string>",
    )


def vote(docs: DataFrame, params: Params = Params()) -> tuple[DataFrame, DataFrame]:
    """Documents ``(doc_id, digest, n_words, copies)`` and spans
    ``(doc_id, digest, template, label, base, first, last, score)``."""
    listed = template_grams(docs.sparkSession, params)
    longest = max(k for *_, k in templates(params))
    rows = stage(gram_rows(docs, sieve_of(listed), before=0, after=longest), "license-grams")
    documents = (
        rows.where(F.col("hash").isNull())
        .groupBy("doc_id", "digest")
        .agg(F.max("n_words").alias("n_words"), F.count("*").alias("copies"))
    )
    key = ["doc_id", "digest", "template", "label", "base", "total"]
    diagonals = (
        rows.where(F.col("hash").isNotNull())
        .drop("n_words")
        .join(listed.withColumnRenamed("k", "words"), "hash")
        .where((F.col("k") == F.col("words")) & (F.slice("around", 1, F.col("k").cast("int")) == F.col("gram")))
        .groupBy(*key, (F.col("pos") - F.col("offset")).alias("diagonal"), "k")
        .agg(
            F.collect_set("offset").alias("offsets"),
            F.min("pos").alias("low"),
            F.max("pos").alias("high"),
        )
    )
    # Base phrases have one k-gram, so each diagonal is a place of its own; only notices merge.
    along = Window.partitionBy(*key).orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(along)
    apart = F.when(F.col("base") | gap.isNull() | (gap > params.reach), 1).otherwise(0)
    numbered = diagonals.select("*", apart.alias("apart")).select("*", F.sum("apart").over(along).alias("cluster"))
    spans = numbered.groupBy(*key, "cluster").agg(
        F.min("low").alias("first"),
        F.max(F.col("high") + F.col("k") - 1).alias("last"),
        (F.size(F.array_distinct(F.flatten(F.collect_list("offsets")))) / F.col("total")).alias("score"),
    )
    return documents, spans.where(F.col("score") >= params.least).drop("cluster", "total")


def scan_licenses(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, spans``, spans in order.

    Null and empty texts have no words. Rows with the same id and text are scanned
    together and given back as often as they are there.
    """
    documents, spans = vote(docs, params)
    by_doc = spans.groupBy("doc_id", "digest").agg(
        F.array_sort(F.collect_list(F.struct("first", "last", "label", "base", "score"))).alias("spans")
    )
    same = F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.digest") == F.col("s.digest"))
    none = F.array().cast(dict(by_doc.dtypes)["spans"])
    return (
        documents.alias("d")
        .join(by_doc.alias("s"), same, "left")
        .select(
            "d.doc_id",
            "n_words",
            F.coalesce("spans", none).alias("spans"),
            F.explode(F.sequence(F.lit(1), "copies")).alias("copy"),
        )
        .drop("copy")
    )


def report(found: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda s: s["base"])
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    starts = F.transform(base, lambda s: s["first"])
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("score"),
    )
