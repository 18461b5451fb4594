"""Risk operators: evidence as subjective-logic opinions (belief b, disbelief d, uncertainty u), their fusion, and AHP weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def metric_opinion(value, low: float, high: float, weight: float):
    """Disbelief grows from 0 at `low` to `weight` at `high`; the rest is uncertain."""
    share = F.lit(0.0) if high == low else F.least(F.lit(1.0), F.greatest(F.lit(0.0), (value - low) / (high - low)))
    d = share * weight
    return F.struct(F.lit(0.0).alias("b"), d.alias("d"), (1 - d).alias("u"))


def finding_opinion(polarity, confidence):
    """Risk-increasing findings speak against, risk-decreasing for, unsure ones for neither; others give null."""
    c, zero = confidence, F.lit(0.0)
    opinion = lambda b, d, u: F.struct(b.alias("b"), d.alias("d"), u.alias("u"))
    return F.when(polarity == "risk-increasing", opinion(zero, c, 1 - c)).when(polarity == "risk-decreasing", opinion(c, zero, 1 - c)).when(polarity == "unsure", opinion((1 - c) / 2, (1 - c) / 2, c))


def fuse(opinions: DataFrame, key: str) -> DataFrame:
    """Cumulative fusion of opinions(key, pos, b, d, u). In closed form: with R the sum of b/u and S of d/u, b = R/(1+R+S), d = S/(1+R+S), u = 1/(1+R+S). An opinion without uncertainty wins, the first one of several."""
    sure = F.min_by(F.struct("b", "d", "u"), F.when(F.col("u") == 0, F.col("pos")))
    r, s = (F.sum(F.when(F.col("u") > 0, F.col(x) / F.col("u")).otherwise(0.0)) for x in "bd")
    sums = opinions.groupBy(key).agg(r.alias("r"), s.alias("s"), F.count_if(F.col("u") == 0).alias("n_sure"), sure.alias("sure"))
    total = 1 + F.col("r") + F.col("s")
    pick = lambda x, v: F.when(F.col("n_sure") > 0, F.col(f"sure.{x}")).otherwise(v / total).alias(x)
    return sums.select(key, pick("b", F.col("r")), pick("d", F.col("s")), pick("u", F.lit(1.0)))


def expectation(b, u, base: float = 0.5):
    return b + base * u


def dashboard(fused: DataFrame) -> DataFrame:
    """Number of opinions, mean expectation, critical (expectation under 0.3) and conflicting ones (b and d over 0.3)."""
    e = expectation(F.col("b"), F.col("u"))
    return fused.agg(F.count("*").alias("n"), F.round(F.avg(e), 3).alias("mean_expectation"), F.count_if(e < 0.3).alias("critical"), F.count_if((F.col("b") > 0.3) & (F.col("d") > 0.3)).alias("conflict"))


#: Random consistency index by matrix size.
RANDOM_INDEX = {1: 0.0, 2: 0.0, 3: 0.58, 4: 0.90, 5: 1.12, 6: 1.24, 7: 1.32, 8: 1.41, 9: 1.45, 10: 1.49}


def ahp(cells: DataFrame, n: int) -> DataFrame:
    """cells(i, j, v), the upper triangle of a comparison matrix -> weight per row, lambda_max, consistency index and ratio."""
    upper = cells.where("i < j")
    whole = upper.select("i", "j", "v").union(upper.select("j", "i", 1 / F.col("v"))).union(upper.sparkSession.range(1, n + 1).select(F.col("id").cast("int"), F.col("id").cast("int"), F.lit(1.0)))
    columns = whole.groupBy("j").agg(F.sum("v").alias("total"))
    weights = whole.join(columns, "j").groupBy("i").agg(F.avg(F.col("v") / F.col("total")).alias("w"))
    each = weights.join(columns, weights["i"] == columns["j"])
    top = each.agg(F.sum(F.col("w") * F.col("total")).alias("lambda_max"))
    ci = (F.col("lambda_max") - n) / max(1, n - 1)
    ratio = ci / RANDOM_INDEX[n] if RANDOM_INDEX[n] else F.lit(0.0)
    return weights.join(F.broadcast(top)).select("i", F.round("w", 6).alias("w"), F.round("lambda_max", 6).alias("lambda_max"), F.round(ci, 6).alias("ci"), F.round(ratio, 6).alias("cr"))


def calibrated(opinions: DataFrame) -> DataFrame:
    """Opinions (key, b, d, u) with valid: whether they sum to 1, by less than 0.001."""
    total = F.col("b") + F.col("d") + F.col("u")
    return opinions.withColumn("valid", F.coalesce((total > 0.999) & (total < 1.001), F.lit(False)))


def metric_thresholds(thresholds: DataFrame, weights: DataFrame) -> DataFrame:
    """thresholds(key, low, high) with the weight of each key in weights(key, w) as the most disbelief that the metric can give."""
    return thresholds.join(weights.select("key", F.col("w").alias("max_disbelief")), "key")
