"""Language of a text: sparse multinomial logistic regression on TF-IDF character n-grams.

Trained with follow-the-regularised-leader (proximal, per coordinate) under an elastic
net, then calibrated by one temperature on rows that were not trained on. N-grams are
hashed into a fixed number of buckets, so the model has a fixed size per language.
"""

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UNDETERMINED = "und"


@dataclass(frozen=True)
class Params:
    """``rows_per_language`` bounds the labelled rows that the weights are fitted on.

    With many languages the bound is lower, the same for all, so that together they have
    at most ``most_rows``, but one row at least each. A language with fewer rows than the
    bound keeps all. Document frequencies always come from all learnable rows.
    """

    bits: int = 15
    longest: int = 3
    rows_per_language: int = 1500
    most_rows: int = 12000
    calibration_part: float = 0.2
    passes: int = 2
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.002
    l2: float = 0.001


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float = 1.0
    params: Params = field(default_factory=Params)


def counts_of(text: str, params: Params) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of a whole text, and how often each is there."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    shift, size = np.uint32(32 - params.bits), 1 << params.bits
    total = np.zeros(size, dtype=np.int64)
    folded = np.zeros(len(points), dtype=np.uint32)
    for n in range(1, params.longest + 1):
        if len(points) < n:
            break
        folded = folded[: len(points) - n + 1] * np.uint32(0x01000193) + points[n - 1 :] + np.uint32(n)
        total += np.bincount((folded * np.uint32(0x9E3779B1)) >> shift, minlength=size)
    buckets = np.flatnonzero(total)
    return buckets, total[buckets]


def weigh(buckets: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    values = np.log1p(counts) * idf[buckets]
    return values / max(np.sqrt((values * values).sum()), 1e-12)


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from; a null id is neither learned from nor held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def readable(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def learnable(docs: DataFrame) -> DataFrame:
    known = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & readable(F.col("text")))
    return known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)


def document_frequencies(rows: DataFrame, params: Params) -> tuple[int, np.ndarray]:
    """Over all rows: one vector per task, added up by bucket before it leaves Spark."""
    size = 1 << params.bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 1, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0):
                total[counts_of(text.as_py(), params)[0]] += 1
                total[size] += 1
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], names=["bucket", "n"])

    counted = rows.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = np.zeros(size + 1, dtype=np.int64)
    for bucket, n in counted.collect():  # at most one row per bucket
        found[bucket] = n
    return int(found[size]), found[:size]


def bound_of(per_language: dict[str, int], params: Params) -> int:
    """The most rows per language, 1 or more, with which all languages fit into ``most_rows``."""
    low, high = 1, max(1, params.rows_per_language)
    while low < high:
        middle = (low + high + 1) // 2
        fits = sum(min(n, middle) for n in per_language.values()) <= params.most_rows
        low, high = (middle, high) if fits else (low, middle - 1)
    return low


def labelled_sample(rows: DataFrame, params: Params) -> list[tuple[str, float, np.ndarray, np.ndarray]]:
    """(language, place in 0..1, buckets, counts) of a bounded number of rows per language.

    Chosen by a hash of the id, so a run gives the same rows for any partitioning.
    """
    per_language = {lang: n for lang, n in rows.groupBy("lang").count().collect()}
    if not per_language:
        return []
    scale = 1 << 24
    bound = bound_of(per_language, params)
    # Far more rows than needed pass the hash, so ranks in a language decide.
    passing = bound + 10 * bound**0.5 + 30
    limits = F.create_map(
        *(
            F.lit(x)
            for lang, n in sorted(per_language.items())
            for x in (lang, int(scale * min(1.0, passing / n)))
        )
    )
    place = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(scale))
    chosen = rows.select("doc_id", "lang", "text", place.alias("place")).where(F.col("place") < limits[F.col("lang")])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets, counts = [], []
            for text in batch.column(2):
                b, c = counts_of(text.as_py(), params)
                buckets.append(b.astype(np.int32).tobytes())
                counts.append(c.astype(np.int32).tobytes())
            kind = pa.binary()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(buckets, kind), pa.array(counts, kind), batch.column(3)],
                names=["doc_id", "lang", "buckets", "counts", "place"],
            )

    id_type = dict(rows.dtypes)["doc_id"]
    sparse = chosen.mapInArrow(features, f"doc_id {id_type}, lang string, buckets binary, counts binary, place long")
    by_place = Window.partitionBy("lang").orderBy("place", "doc_id", "buckets", "counts")
    sparse = sparse.select("*", F.row_number().over(by_place).alias("nth")).where(F.col("nth") <= bound)
    order = F.xxhash64("doc_id", F.lit(71))
    bounded = sparse.select(order.alias("h"), "doc_id", "lang", "buckets", "counts").orderBy("h", "doc_id", "lang", "counts")
    return [
        (r.lang, (r.h % 1000003) / 1000003, np.frombuffer(r.buckets, dtype=np.int32), np.frombuffer(r.counts, dtype=np.int32))
        for r in bounded.collect()
    ]


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], n_languages: int, params: Params) -> np.ndarray:
    """Follow the regularised leader over (buckets, values, language) rows."""
    z = np.zeros((1 << params.bits, n_languages))
    n = np.zeros_like(z)

    def weights(z, n):
        shrunk = np.sign(z) * params.l1 - z
        return np.where(np.abs(z) <= params.l1, 0.0, shrunk / ((params.beta + np.sqrt(n)) / params.alpha + params.l2))

    for _ in range(params.passes):
        for buckets, values, language in rows:
            at_z, at_n = z[buckets], n[buckets]
            w = weights(at_z, at_n)
            error = softmax(values @ w)
            error[language] -= 1.0
            gradient = values[:, None] * error[None, :]
            squared = gradient * gradient
            sigma = (np.sqrt(at_n + squared) - np.sqrt(at_n)) / params.alpha
            z[buckets] = at_z + gradient - sigma * w
            n[buckets] = at_n + squared
    return weights(z, n)


def calibrate(scores: np.ndarray, languages: np.ndarray) -> float:
    """The temperature of least negative log-likelihood, by golden-section search on its logarithm."""
    if not len(scores):
        return 1.0

    def loss(log_t: float) -> float:
        p = softmax(scores / np.exp(log_t))
        return float(-np.log(np.maximum(p[np.arange(len(p)), languages], 1e-12)).mean())

    low, high, golden = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def train(docs: DataFrame, params: Params = Params()) -> Model:
    """Learn from ``doc_id, text, lang`` of learnable rows; no such row gives a model without languages."""
    rows = learnable(docs)
    n_docs, df = document_frequencies(rows, params)
    idf = np.log((1 + n_docs) / (1 + df)) + 1.0
    sample = labelled_sample(rows, params)
    languages = sorted({lang for lang, *_ in sample})
    index = {lang: i for i, lang in enumerate(languages)}
    ready = [(p, b, weigh(b, c, idf), index[lang]) for lang, p, b, c in sample]
    # Of each language the row furthest from the calibration part is fitted, whatever its place.
    furthest = {r[3]: i for i, r in sorted(enumerate(ready), key=lambda e: e[1][0])}
    to_fit = [r[0] >= params.calibration_part or furthest[r[3]] == i for i, r in enumerate(ready)]
    fitted = [r[1:] for r, fits in zip(ready, to_fit) if fits]
    kept_back = [r[1:] for r, fits in zip(ready, to_fit) if not fits]
    weights = fit(fitted, max(1, len(languages)), params)
    scores = np.array([v @ weights[b] for b, v, _ in kept_back])
    temperature = calibrate(scores, np.array([y for *_, y in kept_back], dtype=np.int64))
    return Model(languages, idf.astype(np.float32), weights.astype(np.float32), temperature, params)


def language(spark: SparkSession, text: Column, model: Model) -> Column:
    """``struct<lang_pred, score>`` of a whole text."""
    # Arrays and names only: a class would have to be importable where the executors run.
    shared = spark.sparkContext.broadcast((model.languages, model.idf, model.weights, model.temperature))
    params = model.params

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = Model(*shared.value, params)
        for batch in batches:
            names, best = [], np.zeros(len(batch))
            for i, text in enumerate(batch):
                text = text.as_py()
                if text is None or not model.languages:
                    names.append(UNDETERMINED)
                    continue
                buckets, counts = counts_of(text, model.params)
                p = softmax(weigh(buckets, counts, model.idf) @ model.weights[buckets] / model.temperature)
                names.append(model.languages[int(p.argmax())])
                best[i] = min(1.0, float(p.max()))
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(best)], ["lang_pred", "score"])

    return F.arrow_udf(score, "struct<lang_pred:string,score:double>")(F.when(readable(text), text))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for each row, by the whole text alone.

    A text that is null or has no letter is ``und`` with score 0, and so is everything
    if the model knows no language. Of equally likely languages the first by name is taken.
    Repeated rows and null ids are rows like others.
    """
    found = docs.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        language(docs.sparkSession, F.col("text"), model).alias("found"),
    )
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score")


def identify(docs: DataFrame, params: Params = Params()) -> DataFrame:
    return predict(docs, train(docs, params))
