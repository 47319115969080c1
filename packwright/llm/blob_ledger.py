"""Secret scans with an incremental ledger of blobs.

Every version of a document is addressed by the SHA-256 of its text. The ledger, a
Parquet table, has one row per (blob, rule version) that was scanned, findings included.
A run scans only pairs that are not in it, whatever the number of paths or versions with
the same content, appends them, and joins findings back to all paths. A blob that lacks
several rule versions is read once for all of them.
"""

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

# Kind, pattern, group that is measured, least length. Letters of the
# first are there in either case, ASCII only. In the order of kinds.
BASE_RULES = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
BASE_VERSION = "base-1"

# Credentials that their issuers spell with a prefix of their own.
ISSUER_RULES = (
    ("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    ("google", r"AIza[A-Za-z0-9_-]+", 0, 39),
    ("jwt", r"eyJ[A-Za-z0-9_-]+[.]eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+", 0, 30),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 27),
)
ISSUER_VERSION = "issuer-1"

RULE_VERSIONS = {BASE_VERSION: BASE_RULES, ISSUER_VERSION: ISSUER_RULES}
# Kinds follow each other in this order where they start at one place.
KINDS = [rule[0] for rules in RULE_VERSIONS.values() for rule in rules]

FINDING = "array<struct<start:bigint,rank:int,kind:string,end:bigint>>"
LEDGER = f"blob string, rule_version string, findings {FINDING}"


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def rank_of(kind: str) -> int:
    return KINDS.index(kind) if kind in KINDS else len(KINDS)


def scanner(rule_versions=RULE_VERSIONS):
    """A function of Arrow batches (blob, text, versions it lacks) to ledger rows."""
    ranked = {version: [(kind, rank_of(kind), *rest) for kind, *rest in rules] for version, rules in rule_versions.items()}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A run of the last class that is too short can be skipped at once: what is
        # matched there is the whole run in either case.
        compiled = {
            version: [
                (kind, rank, re.compile(f"[0-9a-f]{{{least},}}" if pattern == r"[0-9a-f]+" else pattern, re.ASCII), group, least)
                for kind, rank, pattern, group, least in rules
            ]
            for version, rules in ranked.items()
        }
        finding = pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("kind", pa.string()), ("end", pa.int64())])
        for batch in batches:
            blobs, versions, found = [], [], []
            for blob, text, lacking in zip(*batch.columns):
                text = text.as_py()
                for version in lacking.as_py():
                    spans = [
                        {"start": m.start(), "rank": rank, "kind": kind, "end": m.end()}
                        for kind, rank, pattern, group, least in compiled[version]
                        for m in pattern.finditer(text)
                        if m.end(group) - m.start(group) >= least
                    ]
                    blobs.append(blob.as_py())
                    versions.append(version)
                    found.append(sorted(spans, key=lambda s: (s["start"], s["rank"])))
            yield pa.RecordBatch.from_arrays(
                [pa.array(blobs, pa.string()), pa.array(versions, pa.string()), pa.array(found, pa.list_(finding))],
                names=["blob", "rule_version", "findings"],
            )

    return scan


def read_ledger(spark, path: str) -> DataFrame:
    """The ledger so far; none yet is an empty one."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def unseen_pairs(versions: DataFrame, ledger: DataFrame, names: list[str]) -> DataFrame:
    """``blob, text, versions``: each distinct text of ``versions`` with the rule versions it was not scanned by.

    Contents meet by their address: equal ones are one row before they are exchanged.
    """
    known = ledger.where(F.col("rule_version").isin(names)).groupBy("blob").agg(F.collect_set("rule_version").alias("seen"))
    blobs = versions.select(blob_of(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
    wanted = F.array(*(F.lit(name) for name in names))
    lacking = F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>")))
    met = blobs.dropDuplicates(["blob"]).join(known, "blob", "left")
    return met.select("blob", "text", lacking.alias("versions")).where(F.size("versions") > 0)


def update_ledger(versions: DataFrame, path: str, rule_versions=RULE_VERSIONS, scanned: Observation | None = None) -> DataFrame:
    """Scan what the ledger lacks of ``versions`` (column ``text``) and append it.

    ``scanned`` tells afterwards how many ``blobs`` were read and how many ``pairs`` with a
    rule version they made, counted by the write itself: none where nothing was new.
    """
    spark = versions.sparkSession
    names = list(rule_versions)
    unseen = unseen_pairs(versions, read_ledger(spark, path), names)
    if scanned is not None:
        pairs = F.coalesce(F.sum(F.size("versions")), F.lit(0))
        unseen = unseen.observe(scanned, F.count("*").alias("blobs"), pairs.cast("long").alias("pairs"))
    unseen.mapInArrow(scanner(rule_versions), LEDGER).write.mode("append").parquet(path)
    return read_ledger(spark, path).where(F.col("rule_version").isin(names))


def scan_secrets(docs: DataFrame, path: str, rule_versions=RULE_VERSIONS, scanned: Observation | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, blob, findings``, in order of start and kind.

    A null text counts as empty. A null or repeated ``doc_id`` is a path like any other;
    each row gets its findings. Starts and ends are code points, ends exclusive. A new rule
    version reads every blob again for its own rules; findings of the others stay.
    """
    ledger = update_ledger(docs, path, rule_versions, scanned)
    found = ledger.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("findings"))).alias("findings"))
    paths = docs.select("doc_id", blob_of(F.col("text")).alias("blob"))
    return paths.join(found, "blob", "left").select("doc_id", "blob", "findings")


def report(found: DataFrame) -> DataFrame:
    """Counts per base kind, and the spans of the base and of all kinds as text."""
    base = [rule[0] for rule in BASE_RULES]
    spell = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )
    count = lambda kind: F.size(F.filter("findings", lambda s: s["kind"] == F.lit(kind))).cast("long")
    of_base = F.filter("findings", lambda s: s["kind"].isin(base))
    return found.select(
        "doc_id",
        *(count(kind).alias(f"n_{kind}") for kind in base),
        F.sha2(spell(of_base), 256).alias("base_sha256"),
        spell(F.col("findings")).alias("spans"),
    )
