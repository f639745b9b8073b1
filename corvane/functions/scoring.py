"""Scores as column expressions: recency, volume damping, gates, calibration, vectors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RankParams:
    """What a ranking depends on; the defaults suit dense encoders with cosines of 0.5 to 0.7 for related texts."""

    now_year: int
    pool: int = 400
    floor: float = 0.47
    strong: float = 0.60
    lexical_weight: float = 0.15
    half_life: float = 4.0
    unknown_year: float = 0.5
    contributing: int = 12
    exponent: float = 0.25
    shown: int = 5
    top_k: int = 10

    def __post_init__(self):
        if not 1 <= self.top_k <= 50:
            raise ValueError("top_k must be 1 to 50")


#: Bands in which raw scores are shown as 0 to 1.
GROUP_BAND, COURSE_BAND = (0.55, 1.1), (0.45, 0.72)


def recency(year: Column, p: RankParams) -> Column:
    age = F.greatest(F.lit(0), F.lit(p.now_year) - year)
    return F.when(year.isNull(), p.unknown_year).otherwise(F.pow(F.lit(0.5), age / p.half_life))


def passes(similarity: Column, overlap: Column, p: RankParams) -> Column:
    """Strong by itself, or fair with a common term."""
    return (similarity >= p.strong) | ((similarity >= p.floor) & (overlap > 0))


def calibrated(raw: Column, band: tuple[float, float]) -> Column:
    low, high = band
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (raw - low) / (high - low)))


def level(calibrated_score: Column) -> Column:
    return F.when(calibrated_score >= 0.8, "very high").when(calibrated_score >= 0.6, "high").when(calibrated_score >= 0.4, "medium").otherwise("low")


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def unit(vector: Column) -> Column:
    """vector with length 1; a zero vector stays as it is."""
    return F.transform(F.array(norm(vector)), lambda n: F.transform(vector, lambda x: F.when(n > 0, x / n).otherwise(x.cast("double"))))[0]


def cosine(a: Column, b: Column) -> Column:
    """Of vectors of length 1, to nine places so that ties are ties on every engine."""
    return F.round(F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x), 9)
