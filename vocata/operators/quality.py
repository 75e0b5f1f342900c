"""Validation rules: taxonomy violations and statistics, table counts, missing tables."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Allowed importance levels, nodes a deep role must have.
LEVELS = ("critical", "high", "medium", "low")
MIN_ROLE_SKILLS = 5


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [t.agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows") for n, t in tables.items()])


def missing_tables(spark, present: DataFrame, expected: list[str]) -> DataFrame:
    """Expected names that ``present`` (``table_name``) lacks."""
    want = spark.createDataFrame([(n,) for n in expected], "table_name string")
    return want.join(present.select("table_name"), "table_name", "left_anti")


def taxonomy_violations(tax: DataFrame, aliases: DataFrame) -> DataFrame:
    """``(rule, subject)`` of every broken rule, once each: unknown importance, missing ids,
    parents that do not exist, an id with two names, an alias of two skills, thin roles."""
    bad = lambda rule, df, c: df.select(F.lit(rule).alias("rule"), F.col(c).cast("string").alias("subject"))
    skill = tax.filter("node_type = 'skill'")
    unknown = bad("importance", skill.filter(F.col("importance").isNotNull() & ~F.col("importance").isin(*LEVELS)), "id")
    unset = bad("importance_missing", skill.filter("importance IS NULL"), "id")
    no_id = bad("skill_id_missing", skill.filter("skill_id IS NULL"), "id")
    parent = tax.select(F.col("id").alias("parent_id"))
    orphan = bad("parent_missing", tax.filter("parent_id IS NOT NULL").join(parent, "parent_id", "left_anti"), "id")
    names = bad("two_names", skill.groupBy("skill_id").agg(F.countDistinct(F.lower("node_name")).alias("n")).filter("n > 1"), "skill_id")
    shared = aliases.filter("skill_id IS NOT NULL").groupBy(F.lower(F.trim("alias_text")).alias("a")).agg(F.countDistinct("skill_id").alias("n")).filter("n > 1")
    thin = bad("thin_role", skill.groupBy("industry_id", "role_id").agg(F.countDistinct("skill_id").alias("n")).filter(F.col("n") < MIN_ROLE_SKILLS), "role_id")
    return reduce(DataFrame.unionByName, [unknown, unset, no_id, orphan, names, bad("alias_of_two", shared, "a"), thin]).distinct()


def taxonomy_stats(tax: DataFrame) -> DataFrame:
    """Nodes and distinct skills per industry and node type."""
    return tax.groupBy("industry_id", "node_type").agg(F.count("*").alias("n_nodes"), F.countDistinct("skill_id").alias("n_skills"))
