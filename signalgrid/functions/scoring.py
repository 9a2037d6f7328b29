"""Severity, threat and tone as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from signalgrid import fixed_values as fv


def _number(value: Column) -> Column:
    """The value, or 0 if it is null or not a number; both would win or lose every comparison."""
    return F.coalesce(F.nanvl(value.cast("double"), F.lit(0.0)), F.lit(0.0))


def severity_by_share(count: Column, peak: Column) -> Column:
    """Square root of the share of the largest count, at most 1."""
    share = F.greatest(_number(count), F.lit(0.0)) / peak
    return F.least(F.lit(1.0), F.sqrt(share))


def severity_by_fatalities(fatalities: Column) -> Column:
    """Base level plus half the decimal logarithm of the toll, at most 1."""
    toll = F.greatest(_number(fatalities), F.lit(0.0))
    return F.least(
        F.lit(1.0),
        F.lit(fv.FATALITY_BASE) + F.log10(toll + 1) / fv.FATALITY_DIVISOR,
    )


def threat_band(score: Column, bands=fv.THREAT_BANDS, floor=fv.THREAT_FLOOR) -> Column:
    """Name of the highest band whose lower edge the score reaches."""
    known = F.nanvl(score.cast("double"), F.lit(None))
    reached = [F.when(known >= edge, F.lit(name)) for edge, name in bands]
    return F.coalesce(*reached, F.lit(floor))


def pressure_score(volume: Column, intensity: Column) -> Column:
    """Weighted sum of relative volume and mean severity, at most 1."""
    return F.least(
        F.lit(1.0),
        fv.VOLUME_WEIGHT * volume + fv.INTENSITY_WEIGHT * intensity,
    )


def tone_level(tone: Column) -> Column:
    """Tone limited to the gauge's range; a missing tone is 0."""
    return F.greatest(F.lit(-fv.TONE_LIMIT), F.least(F.lit(fv.TONE_LIMIT), _number(tone)))


def tone_percent(tone: Column) -> Column:
    """Position of the limited tone on the gauge, 0 to 100."""
    return (tone_level(tone) + fv.TONE_LIMIT) / (2 * fv.TONE_LIMIT) * 100


def tone_band(tone: Column) -> Column:
    below = [F.when(tone_level(tone) < edge, F.lit(name)) for edge, name in fv.TONE_BANDS]
    return F.coalesce(*below, F.lit(fv.TONE_CALM))
