"""Write semantics of a keyed store without row-level updates: each returns the new table.

``existing`` and ``incoming`` have the same columns unless said otherwise. Rows with a null
key are never equal to another row; incoming rows with a null key are left out. Among
incoming rows of one key the first by ``order`` wins, so results do not depend on row order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*[F.asc_nulls_last(c) for c in order])
    return df.dropna(subset=list(keys)).withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], update: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Inserts new keys; of known ones only the columns of ``update`` change, also to null."""
    new = first_per_key(incoming, keys, order).select(*keys, F.struct(*[c for c in incoming.columns if c not in keys]).alias("_n"))
    old = existing.select(*keys, F.struct(*[c for c in existing.columns if c not in keys]).alias("_o"))
    both = old.join(new, list(keys), "full")
    cols = [c if c in keys else F.when(F.col("_n").isNotNull() & (F.lit(c in update) | F.col("_o").isNull()), F.col(f"_n.{c}")).otherwise(F.col(f"_o.{c}")).alias(c) for c in existing.columns]
    return both.select(*cols)


def insert_ignore(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Inserts the keys that are new; known ones stay as they are."""
    fresh = first_per_key(incoming, keys, order).join(existing.select(*keys), list(keys), "left_anti")
    return existing.unionByName(fresh.select(*existing.columns))


def replace_children(existing: DataFrame, incoming: DataFrame, parent: str) -> DataFrame:
    """Deletes all rows of the parents that are delivered, then inserts the delivered rows."""
    return existing.join(incoming.select(parent).distinct(), parent, "left_anti").unionByName(incoming.select(*existing.columns)).select(*existing.columns)


def upgrade_evidence(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], evidence: str = "evidence", section: str = "source_section") -> DataFrame:
    """Evidence only ever rises from inferred to explicit, and the section changes only with it; new keys are inserted."""
    w = W.partitionBy(*keys).orderBy(F.when(F.col(evidence) == "explicit", 0).otherwise(1), F.asc_nulls_last(section))
    new = incoming.dropna(subset=list(keys)).withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").select(*keys, F.struct(evidence, section).alias("_n"))
    old = existing.select(*keys, F.struct(evidence, section).alias("_o"))
    both = old.join(new, list(keys), "full")
    rises = F.col("_o").isNull() | ((F.col(f"_n.{evidence}") == "explicit") & F.coalesce(F.col(f"_o.{evidence}") != "explicit", F.lit(True)))
    take = F.col("_n").isNotNull() & rises
    return both.select(*keys, *[F.when(take, F.col(f"_n.{c}")).otherwise(F.col(f"_o.{c}")).alias(c) for c in (evidence, section)])


def flip_status(existing: DataFrame, done: DataFrame, failed: DataFrame, key: str, status: str = "parsed_status") -> DataFrame:
    """``pending`` rows of ``done`` become ``parsed``; rows of ``failed`` become ``failed`` whatever they were."""
    d = done.select(key).distinct().withColumn("_d", F.lit(True))
    f = failed.select(key).distinct().withColumn("_f", F.lit(True))
    new = F.when(F.col("_f"), "failed").when(F.col("_d") & (F.col(status) == "pending"), "parsed").otherwise(F.col(status))
    return existing.join(d, key, "left").join(f, key, "left").withColumn(status, new).select(*existing.columns)


def or_default(value: Column, default: str | None) -> Column:
    """The value without spaces around it, or the default (or null) where it is null or blank."""
    return F.coalesce(F.nullif(F.trim(value), F.lit("")), F.lit(default).cast("string"))
