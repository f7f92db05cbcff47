"""Energy formulas as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Emission factor, seconds per hour, reference pace of the score.
CARBON_KG_PER_KWH = 0.5
SECONDS_PER_HOUR = 3600.0
SCORE_STEPS_PER_HOUR = 100.0


def hours(seconds: Column) -> Column:
    return seconds / F.lit(SECONDS_PER_HOUR)


def fixed(figure: Column, digits: int) -> Column:
    """Round half to even, as the published figures are rounded."""
    return F.bround(figure, digits)


def carbon_kg(kwh: Column) -> Column:
    return fixed(kwh * F.lit(CARBON_KG_PER_KWH), 6)


def efficiency_score(kwh: Column, steps: Column, seconds: Column) -> Column:
    """Wh per step over the pace in hundreds of steps per hour; lower is better."""
    wh_per_step = kwh * 1000.0 / F.nullif(steps, F.lit(0))
    pace = steps / hours(F.nullif(seconds, F.lit(0.0)))
    score = wh_per_step / F.greatest(F.lit(1.0), pace / F.lit(SCORE_STEPS_PER_HOUR))
    return F.when((steps == 0) | (seconds == 0), F.lit(0.0)).otherwise(fixed(score, 4))


def energy_efficiency(wh: Column, step: Column, last_step: Column, util: Column) -> Column:
    """Wh per step, raised for poor utilisation; infinite without progress or load."""
    steps = step - last_step
    value = wh / F.when(steps > 0, steps) / F.greatest(F.lit(0.01), util / 100.0)
    return F.when((steps <= 0) | (util <= 0), F.lit(float("inf"))).otherwise(value)
