"""The given tables."""

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Tasks for scans of costly row work; without it a scan is cut as the reader cuts it.
SCAN_TASKS = "packwright.scan.tasks"


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal a scan out to as many tasks as the session's ``packwright.scan.tasks`` says.

    For few, small files on many cores. It is never decided here: large tables have their
    own splits, and dealing them out would shuffle all texts.
    """
    tasks = df.sparkSession.conf.get(SCAN_TASKS, None)
    return df.repartition(int(tasks), *keys) if tasks else df
