"""Learning-rate schedule as a column expression."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rates and the share of steps spent warming up.
LEARNING_RATE = 3e-5
END_LEARNING_RATE = 0.0
WARMUP_RATE = 0.1


def _col(value: Column | float | int) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def warmup_steps(total_steps: Column | int, rate: float = WARMUP_RATE) -> Column:
    return F.floor(_col(total_steps).cast("double") * F.lit(rate)).cast("bigint")


def cosine_rate(
    step: Column,
    total_steps: Column | int,
    warmup: Column | int,
    rate: float = LEARNING_RATE,
    end_rate: float = END_LEARNING_RATE,
) -> Column:
    """Linear warm-up, then half a cosine down to ``end_rate``; ``end_rate`` past the last step."""
    step, total, warm = (_col(c).cast("double") for c in (step, total_steps, warmup))
    peak, floor = F.lit(float(rate)), F.lit(float(end_rate))
    span = F.when(total > warm, total - warm).otherwise(F.lit(1.0))
    wave = F.lit(0.5) * (F.lit(1.0) + F.cos(F.lit(math.pi) * (step - warm) / span))
    return (
        F.when(step < warm, peak * step / F.when(warm > 0, warm))
        .when(step > total, floor)
        .otherwise(floor + wave * (peak - floor))
    )
