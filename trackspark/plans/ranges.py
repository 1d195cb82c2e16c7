"""Interval joins as equi-joins on buckets of the ordered axis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 4096


def points_in_ranges(points, ranges, keys: list[str], at: str, lo: str, hi: str, width=WIDTH, how="inner") -> DataFrame:
    """Join each point to every range with ``lo <= at <= hi`` and equal keys."""
    left = points.withColumn("_b", F.floor(F.col(at) / width))
    buckets = F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))
    right = ranges.where(F.col(lo) <= F.col(hi)).withColumn("_b", F.explode(buckets))
    right = right.select(*[F.col(k).alias("_k_" + k) for k in keys], *[c for c in right.columns if c not in keys])
    right = right.withColumnRenamed("_b", "_rb")
    cond = (left["_b"] == right["_rb"]) & (F.col(at) >= F.col(lo)) & (F.col(at) <= F.col(hi))
    for k in keys:
        cond = cond & (left[k] == right["_k_" + k])
    return left.join(right, cond, how).drop("_b", "_rb", *["_k_" + k for k in keys])


def overlaps(a, b, keys: list[str], a_lo: str, a_hi: str, b_lo: str, b_hi: str, width=WIDTH) -> DataFrame:
    """Pairs of intervals with equal keys that share more than a point; each pair once."""
    def cut(df, lo, hi, name):
        spans = F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))
        return df.where(F.col(lo) < F.col(hi)).withColumn(name, F.explode(spans))

    left, right = cut(a, a_lo, a_hi, "_b"), cut(b, b_lo, b_hi, "_b")
    pairs = left.join(right, [*keys, "_b"])
    lo, hi = F.greatest(a_lo, b_lo), F.least(a_hi, b_hi)
    return pairs.where((lo < hi) & (F.floor(lo / width) == F.col("_b"))).drop("_b")
