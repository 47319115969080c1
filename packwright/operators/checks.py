"""Rules on rows, reported as counts."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def same_length(left: Column, right: Column) -> Column:
    return F.size(left) == F.size(right)


def targets_end_at(ids: Column, mask: Column, eos_id: int) -> Column:
    """Wherever a target stops inside the arrays, its last id is ``eos_id``.

    A mask that is shifted against its ids, or cut out at other places than they are,
    breaks this, though it is as long as they are.
    """
    inner = F.filter(F.sequence(F.lit(1), F.size(mask)), lambda i: i < F.size(mask))
    stops = lambda i: (F.element_at(mask, i) == 1) & (F.element_at(mask, i + 1) == 0)
    return F.forall(inner, lambda i: ~stops(i) | (F.element_at(ids, i) == eos_id))


def check_rules(df: DataFrame, rules: dict[str, Column], fail: bool = False) -> DataFrame:
    """One row per rule: rows checked and rows that break it (a null verdict breaks it).

    All rules share one pass over the data. With ``fail`` a broken rule stops the job.
    """
    broken = [
        F.sum(F.when(F.coalesce(ok, F.lit(False)), 0).otherwise(1)).alias(name)
        for name, ok in rules.items()
    ]
    counts = df.agg(F.count("*").alias("_rows"), *broken)
    report = counts.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("rule"),
                        F.col("_rows").alias("n_checked"),
                        F.coalesce(F.col(name), F.lit(0)).cast("bigint").alias("n_violations"),
                    )
                    for name in rules
                ]
            )
        ).alias("r")
    ).select("r.*")
    if fail:
        message = F.concat(F.lit("rule broken: "), F.col("rule"))
        verdict = F.when(F.col("n_violations") > 0, F.raise_error(message).cast("bigint"))
        report = report.withColumn("n_violations", F.coalesce(verdict, F.col("n_violations")))
    return report
