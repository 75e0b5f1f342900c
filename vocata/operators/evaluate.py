"""Precision, recall and F1 of predicted against true (document, skill) pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scores(pred: DataFrame, truth: DataFrame, roles: DataFrame) -> DataFrame:
    """``(role_id, tp, fp, fn, precision, recall, f1)`` per role, and overall with a null role and ``overall`` true.

    ``pred`` and ``truth`` are ``(doc_id, canonical_id)`` in any repetition; ``roles`` is one
    row per judged ``doc_id``, and other documents do not count. A zero divisor gives 0.
    """
    p = pred.select("doc_id", "canonical_id").distinct().withColumn("p", F.lit(1))
    t = truth.select("doc_id", "canonical_id").distinct().withColumn("t", F.lit(1))
    both = p.join(t, ["doc_id", "canonical_id"], "full").join(roles, "doc_id").select("role_id", F.coalesce("p", F.lit(0)).alias("p"), F.coalesce("t", F.lit(0)).alias("t"))
    n = both.rollup("role_id").agg(F.sum(F.col("p") * F.col("t")).alias("tp"), F.sum(F.col("p") * (1 - F.col("t"))).alias("fp"), F.sum((1 - F.col("p")) * F.col("t")).alias("fn"), F.grouping("role_id").alias("g"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    n = n.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    f1 = ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return n.select("role_id", (F.col("g") == 1).alias("overall"), "tp", "fp", "fn", *[F.round(c, 6).alias(a) for c, a in ((F.col("precision"), "precision"), (F.col("recall"), "recall"), (f1, "f1"))])
