"""Queries of the general data-quality operators over the project's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.references import orphan_references, orphan_report, target_state
from ..session import table

# src_table, referring field, target table
REFERENCES = (("candidate_skills", "candidate_id", "candidates"), ("candidate_skills", "skill_id", "skills"), ("skills", "taxonomy_id", "skill_taxonomy"))


def p1_orphans(spark: SparkSession, sf: str) -> DataFrame:
    """``(src_table, ref_field, row_id, k0, null_mask, ref_at, reason)`` of every reference that does not hold."""
    log, parts = table(spark, sf, "removal_log"), []
    for src, field, target in REFERENCES:
        gone = log.filter(F.col("entity_name") == target)
        state = target_state(table(spark, sf, target), ["id"], "created_at", gone, ["entity_id"], "removed_at")
        found = orphan_references(table(spark, sf, src), [field], "id", state, "created_at")
        parts.append(found.withColumns({"src_table": F.lit(src), "ref_field": F.lit(field)}))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return p1_orphans(spark, sf).select("src_table", "row_id", "ref_field").distinct()


def p1_report(spark: SparkSession, sf: str) -> DataFrame:
    return orphan_report(p1_orphans(spark, sf))


def p1_composite(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs (candidate_id, skill_id) of candidate_skills that no hit in a text of the candidate bears out, under each match semantics.

    Either half of the pair may be null; a hit names its candidate by the number of its document.
    """
    number = F.regexp_extract("doc_id", r"_0*([0-9]+)$", 1).try_cast("long")
    hits = table(spark, sf, "skill_hits").select(number.alias("candidate_id"), "skill_id")
    state, refs, parts = target_state(hits, ["candidate_id", "skill_id"]), table(spark, sf, "candidate_skills"), []
    for match in ("simple", "partial", "full"):
        found = orphan_references(refs, ["candidate_id", "skill_id"], "id", state, match=match)
        parts.append(found.select(F.lit(match).alias("match"), "row_id", F.col("k0").alias("candidate_id"), F.col("k1").alias("skill_id"), "null_mask", "reason"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def queries() -> dict:
    return {"p1_found": p1_found, "p1_report": p1_report, "p1_composite": p1_composite}


def _orphans(src: str, field: str, target: str) -> str:
    return f"""SELECT DISTINCT '{src}' AS src_table, r.id AS row_id, '{field}' AS ref_field, r.{field} AS k0, r.created_at AS ref_at,
  CASE WHEN t.id IS NULL THEN 'absent' WHEN g.at >= t.last_at OR (g.at IS NOT NULL AND t.last_at IS NULL) THEN 'removed' ELSE 'later' END AS reason
FROM {src} r
LEFT JOIN (SELECT id, min(created_at) AS first_at, max(created_at) AS last_at FROM {target} WHERE id IS NOT NULL GROUP BY id) t ON t.id = r.{field}
LEFT JOIN (SELECT entity_id, max(removed_at) AS at FROM removal_log WHERE entity_name = '{target}' GROUP BY entity_id) g ON g.entity_id = r.{field}
WHERE r.{field} IS NOT NULL AND (t.id IS NULL OR g.at >= t.last_at OR (g.at IS NOT NULL AND t.last_at IS NULL) OR t.first_at > r.created_at)"""


_COMPOSITE = """WITH hit AS (SELECT DISTINCT TRY_CAST(regexp_extract(doc_id, '_0*([0-9]+)$', 1) AS BIGINT) AS c, skill_id AS s FROM skill_hits WHERE skill_id IS NOT NULL AND regexp_matches(doc_id, '_0*[0-9]+$')),
r AS (SELECT DISTINCT id AS row_id, candidate_id, skill_id, CASE WHEN candidate_id IS NULL THEN 1 ELSE 0 END + CASE WHEN skill_id IS NULL THEN 2 ELSE 0 END AS null_mask FROM candidate_skills),
whole AS (SELECT * FROM r WHERE null_mask = 0 AND NOT EXISTS (SELECT 1 FROM hit WHERE c = candidate_id AND s = skill_id))
SELECT 'simple' AS match, *, 'absent' AS reason FROM whole UNION ALL SELECT 'full', *, 'absent' FROM whole UNION ALL SELECT 'full', *, 'mixed_nulls' FROM r WHERE null_mask IN (1, 2)
UNION ALL SELECT 'partial', *, 'absent' FROM whole UNION ALL SELECT 'partial', *, 'absent' FROM r WHERE null_mask = 1 AND skill_id NOT IN (SELECT s FROM hit)
UNION ALL SELECT 'partial', *, 'absent' FROM r WHERE null_mask = 2 AND candidate_id NOT IN (SELECT c FROM hit WHERE c IS NOT NULL)"""


def oracle_sql() -> dict[str, str]:
    every = " UNION ALL ".join(_orphans(*x) for x in REFERENCES)
    return {
        "p1_composite": _COMPOSITE,
        "p1_found": f"SELECT DISTINCT src_table, row_id, ref_field FROM ({every})",
        "p1_report": f"""SELECT src_table, ref_field, strftime(ref_at, '%Y-%m') AS month, reason, count(DISTINCT row_id) AS n_rows, count(DISTINCT k0) AS n_keys
FROM ({every}) GROUP BY ALL""",
    }
