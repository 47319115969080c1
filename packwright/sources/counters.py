"""Counters of what is written, worked out by the write itself.

They are observed metrics: aggregates that the engine fills while the rows pass by, so no
second scan is needed. They stand right before the write, in the stage whose tasks commit
the files; a task that is tried again counts once.
"""

from collections.abc import Callable
from contextlib import contextmanager
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

# Reasons a line or turn cannot be used, by how the reason begins.
REASONS = ("malformed line", "no conversations", "no text", "unknown speaker")


def total(value: Column) -> Column:
    """Sum of whole numbers, 0 over no rows."""
    return F.coalesce(F.sum(value), F.lit(0)).cast("bigint")


def rows_where(condition: Column) -> Column:
    return F.count(F.when(condition, 1)).cast("bigint")


class Counted:
    """The rows to write, and after the write what was counted."""

    def __init__(self, rows: DataFrame, counts: dict[str, Column]):
        self.observation = Observation()
        self.rows = rows.observe(self.observation, *[c.alias(name) for name, c in counts.items()])

    @property
    def counts(self) -> dict[str, int]:
        return dict(self.observation.get)


@contextmanager
def counted(rows: DataFrame, counts: dict[str, Column]) -> Iterator[Counted]:
    """``with counted(rows, counts) as c: c.rows.write...`` and then ``c.counts``."""
    yield Counted(rows, counts)


def span_counts() -> dict[str, Column]:
    """Of the spans that ``tokenize_files`` writes."""
    fine = F.col("status") == "ok"
    reason = F.coalesce(F.col("reason"), F.lit(""))
    return {
        "turns": rows_where(fine),
        "tokens": total(F.when(fine, F.col("n"))),
        "target_tokens": total(F.when(fine & (F.col("is_target") == 1), F.col("n"))),
        "rejected": rows_where(~fine),
        **{f"rejected: {r}": rows_where(~fine & reason.startswith(r)) for r in REASONS},
    }


def block_counts(array_total: Callable[[Column], Column]) -> dict[str, Column]:
    """Of the blocks that ``pack_spans`` writes."""
    return {
        "blocks": rows_where(F.lit(True)),
        "tokens": total(F.size("token_ids").cast("bigint")),
        "target_tokens": total(array_total(F.col("tgt_mask"))),
    }
