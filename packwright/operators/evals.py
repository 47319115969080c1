"""Evaluation suites: tasks, metric look-up, scores, and suites still to run."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packwright.sources.suites import SUITES

RESULTS_SCHEMA = "struct<results: map<string, string>>"
METRICS_SCHEMA = "map<string, string>"


def suite_table(spark: SparkSession, suites: dict = SUITES) -> DataFrame:
    """One row per suite. Its size is that of the configuration."""
    rows = [(name, ",".join(s["tasks"]), s["n_shots"], s["metric_name"]) for name, s in suites.items()]
    return spark.createDataFrame(rows, "suite string, tasks string, n_shots int, metric_name string")


def suite_tasks(suites: DataFrame) -> DataFrame:
    return suites.select(
        "suite", "metric_name", "n_shots", F.explode(F.split("tasks", ",")).alias("task")
    )


def parse_results(document: Column) -> Column:
    """Map of task, or group of tasks, to map of metric, or task, to value (text, as values
    need not be numbers). An entry that is no object is null and leaves the others alone."""
    entries = F.from_json(document, RESULTS_SCHEMA)["results"]
    return F.transform_values(entries, lambda _, entry: F.from_json(entry, METRICS_SCHEMA))


def metric_of(results: Column, task: Column, metric: Column) -> Column:
    """Value of ``metric`` for ``task``; null where either is absent.

    A task that is no entry itself is looked for inside the groups; the first that has it counts.
    """
    inside = F.transform(F.map_values(results), lambda group: F.try_element_at(group, task))
    of_group = F.from_json(F.try_element_at(F.filter(inside, lambda m: m.isNotNull()), F.lit(1)), METRICS_SCHEMA)
    metrics = F.coalesce(F.try_element_at(results, task), of_group)
    return F.try_element_at(metrics, F.concat(metric, F.lit(",none"))).try_cast("double")


def look_up_metrics(
    documents: DataFrame, keys: list[str], mode: str = "report", suites: dict = SUITES
) -> DataFrame:
    """Every task of a result document's suite, with its value and whether it is missing.

    ``documents`` has ``keys``, ``suite`` and ``results`` (the parsed map). The tasks are
    broadcast: they come from a literal in this program, one row per task in it.
    """
    tasks = suite_tasks(suite_table(documents.sparkSession, suites))
    rows = documents.join(F.broadcast(tasks), "suite").select(
        *keys, "suite", "task", "metric_name",
        metric_of(F.col("results"), F.col("task"), F.col("metric_name")).alias("value"),
    )
    if mode == "fail":
        message = F.concat(F.lit("no result for task "), F.col("task"))
        return rows.withColumn(
            "value", F.coalesce("value", F.raise_error(message).cast("double"))
        ).withColumn("missing", F.lit(False))
    if mode != "report":
        raise ValueError(f"unknown mode {mode!r}")
    return rows.withColumn("missing", F.col("value").isNull())


def suite_scores(values: DataFrame, keys: list[str], digits: int | None = None) -> DataFrame:
    """Plain mean over the tasks of a suite, the missing count, and the report line.

    A suite with a missing task has no score: the mean over the rest is not its mean.
    """
    mean = F.avg("value") if digits is None else F.round(F.avg("value"), digits)
    scored = values.groupBy(*keys, "suite", "metric_name").agg(
        F.sum(F.col("missing").cast("bigint")).alias("n_missing"), mean.alias("mean")
    )
    complete = F.col("n_missing") == 0
    line = F.concat_ws("", "suite", F.lit(": "), "metric_name", F.lit(" = "), F.col("mean").cast("string"))
    return scored.select(
        *keys,
        "suite",
        "metric_name",
        "n_missing",
        F.when(complete, F.col("mean")).alias("metric_value"),
        F.when(complete, line).alias("report_line"),
    )
