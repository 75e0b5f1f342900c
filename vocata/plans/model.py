"""The operational model over the project's tables: one row per natural key, and its SQL.

Rows delivered again are reduced to the latest by a row number that a group limit pushes
below the shuffle. ``MODEL_SQL`` states the same tables as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import table

#: The industry of the deep vertical.
INDUSTRY = "insight_services"
# Ordinal of the importance levels and the weights of the readiness score.
IMPORTANCE = ("critical", "high", "medium", "low")
READINESS_WEIGHTS = {"tech_score": 35, "projects_score": 25, "experience_score": 20, "education_score": 10, "market_score": 10}


def latest(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row per key: the greatest by ``order``, nulls last; null keys are left out."""
    w = W.partitionBy(*keys).orderBy(*[F.desc_nulls_last(c) for c in order])
    return df.dropna(subset=keys).withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def importance_rank(c):
    """Ordinal of an importance level from 1, 0 if absent or null."""
    return F.coalesce(F.array_position(F.array(*[F.lit(x) for x in IMPORTANCE]), c), F.lit(0)).cast("long")


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    return latest(table(spark, sf, "candidates"), ["id"], "updated_at", "created_at", "full_name", "email", "location", "target_role_id", "seniority_band", "source")


def skills(spark, sf) -> DataFrame:
    return latest(table(spark, sf, "skills"), ["id"], "updated_at", "created_at", "canonical_name", "taxonomy_id", "canonical_id")


def taxonomy(spark, sf) -> DataFrame:
    return latest(table(spark, sf, "skill_taxonomy"), ["id"], "created_at", "node_name", "importance", "parent_id")


def aliases(spark, sf) -> DataFrame:
    """First alias per normalised text wins."""
    rows = table(spark, sf, "skill_alias").filter("skill_id IS NOT NULL").withColumn("norm", F.lower(F.trim("alias_text")))
    w = W.partitionBy("norm").orderBy(F.asc_nulls_last("id"), F.asc_nulls_last("skill_id"))
    return rows.filter("norm IS NOT NULL").withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").select("id", "alias_text", F.col("norm").alias("alias_text_norm"), "skill_id")


def candidate_skills(spark, sf) -> DataFrame:
    """First row per (candidate, skill)."""
    rows = table(spark, sf, "candidate_skills").dropna(subset=["candidate_id", "skill_id"])
    w = W.partitionBy("candidate_id", "skill_id").orderBy(F.asc_nulls_last("created_at"), F.asc_nulls_last("id"), F.asc_nulls_last("evidence"), F.asc_nulls_last("proficiency"), F.asc_nulls_last("source_section"))
    return rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def pairs(spark, sf) -> DataFrame:
    """Distinct (candidate_id, skill_id); cheaper than :func:`candidate_skills` where nothing else is read."""
    return table(spark, sf, "candidate_skills").select("candidate_id", "skill_id").dropna().distinct()


def _ids(c: str):
    return F.array_distinct(F.filter(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.lower(F.regexp_replace(x, r"^\s+|\s+$", ""))), lambda x: x != ""))


def labels(spark, sf) -> DataFrame:
    """Latest label of each resume: ``(resume_id, role_id, name, skills)``."""
    rows = latest(table(spark, sf, "synthetic_resume").withColumn("_j", F.to_json("skills")), ["resume_id"], "generated_at", "_j", "name")
    return rows.select("resume_id", F.col("target_role_id").alias("role_id"), "name", _ids("skills").alias("skills"))


def jobs(spark, sf) -> DataFrame:
    """Latest label of each advert as a posting."""
    rows = table(spark, sf, "synthetic_jd").withColumn("_j", F.to_json("required_skills")).withColumn("_p", F.to_json("preferred_skills"))
    rows = latest(rows, ["jd_id"], "generated_at", "_j", "_p", "job_title", "company")
    return rows.select(F.col("jd_id").alias("job_id"), F.col("target_role_id").alias("role_id"), "job_title", "company", "seniority_band", "min_years_experience", _ids("required_skills").alias("required"), _ids("preferred_skills").alias("preferred"))


def job_skills(spark, sf) -> DataFrame:
    """``(job_id, skill_id, importance, is_required)``; preferred skills that are required as well count as required."""
    j = jobs(spark, sf)
    every = j.select("job_id", F.explode("required").alias("canonical_id"), F.lit("high").alias("importance"), F.lit(1).alias("is_required")).unionByName(
        j.select("job_id", F.explode(F.array_except("preferred", "required")).alias("canonical_id"), F.lit("low").alias("importance"), F.lit(0).alias("is_required"))
    )
    return every.join(skills(spark, sf).select("canonical_id", F.col("id").alias("skill_id")), "canonical_id").select("job_id", "skill_id", "importance", "is_required").distinct()


def readiness(spark, sf) -> DataFrame:
    """Scored candidates, from the order table: sub-scores by key, total by the weights."""
    o = table(spark, sf, "orders")
    score = lambda k: F.pmod(F.col("o_orderkey") * k, F.lit(101)).cast("long")
    rows = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("candidate_id"), F.col("o_orderdate").alias("scored_at"), *[score(k).alias(n) for n, k in zip(READINESS_WEIGHTS, (7, 11, 13, 17, 19))])
    return rows.withColumn("readiness_score", readiness_score())


def readiness_score():
    """Weighted sum of the sub-scores, rounded to two places."""
    return F.round(sum(F.col(c) * w for c, w in READINESS_WEIGHTS.items()) / 100, 2)


def latest_readiness(spark, sf) -> DataFrame:
    """Latest score per candidate; among equal times the greatest id."""
    return latest(readiness(spark, sf), ["candidate_id"], "scored_at", "id")


_ONE = "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY {o}) AS rn FROM {t} WHERE {k} IS NOT NULL) WHERE rn = 1"
_DOWN = lambda cs: ", ".join(f"{c} DESC NULLS LAST" for c in cs.split())
_CLEAN = "list_distinct(list_filter(list_transform(coalesce({c}, []), lambda x: lower(regexp_replace(x, '^\\s+|\\s+$', '', 'g'))), lambda x: x <> ''))"
MODEL_SQL = f"""WITH cand AS ({_ONE.format(k="id", t="candidates", o=_DOWN("updated_at created_at full_name email location target_role_id seniority_band source"))}),
sk AS ({_ONE.format(k="id", t="skills", o=_DOWN("updated_at created_at canonical_name taxonomy_id canonical_id"))}),
tax AS ({_ONE.format(k="id", t="skill_taxonomy", o=_DOWN("created_at node_name importance parent_id"))}),
cs AS (SELECT DISTINCT candidate_id, skill_id FROM candidate_skills WHERE candidate_id IS NOT NULL AND skill_id IS NOT NULL),
lab AS (SELECT resume_id, target_role_id AS role_id, {_CLEAN.format(c="skills")} AS skills FROM ({_ONE.format(k="resume_id", t="synthetic_resume", o="generated_at DESC NULLS LAST, to_json(skills) DESC, name DESC NULLS LAST")})),
job AS (SELECT jd_id AS job_id, target_role_id AS role_id, job_title, company, seniority_band, min_years_experience, {_CLEAN.format(c="required_skills")} AS required, {_CLEAN.format(c="preferred_skills")} AS preferred
  FROM ({_ONE.format(k="jd_id", t="synthetic_jd", o="generated_at DESC NULLS LAST, to_json(required_skills) DESC, to_json(preferred_skills) DESC, job_title DESC NULLS LAST, company DESC NULLS LAST")})),
jskills AS (SELECT DISTINCT job_id, sk.id AS skill_id, importance, is_required FROM (
  SELECT job_id, unnest(required) AS canonical_id, 'high' AS importance, 1 AS is_required FROM job UNION ALL
  SELECT job_id, canonical_id, 'low', 0 FROM (SELECT job_id, required, unnest(preferred) AS canonical_id FROM job) WHERE NOT list_contains(required, canonical_id)) e JOIN sk USING (canonical_id)),
cr AS (SELECT *, round((35 * tech_score + 25 * projects_score + 20 * experience_score + 10 * education_score + 10 * market_score) / 100, 2) AS readiness_score FROM (
  SELECT o_orderkey AS id, o_custkey AS candidate_id, o_orderdate AS scored_at, o_orderkey * 7 % 101 AS tech_score, o_orderkey * 11 % 101 AS projects_score, o_orderkey * 13 % 101 AS experience_score,
    o_orderkey * 17 % 101 AS education_score, o_orderkey * 19 % 101 AS market_score FROM orders)),
lr AS ({_ONE.format(k="candidate_id", t="cr", o="scored_at DESC, id DESC")}),
role_skill AS (SELECT * FROM tax WHERE node_type = 'skill' AND industry_id = '{INDUSTRY}')
"""
