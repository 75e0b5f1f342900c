"""Star schema and analytical queries over the operational model, and their SQL.

Correlated subqueries become aggregates joined once; the skills and taxonomy sides are
broadcast after a count. Two grains of the fact: ``declared`` (candidate, skill) and
``joined``, which repeats a row for each requiring job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut, small, table, tiled
from . import model as m

SCORES = ("readiness_score", "tech_score", "projects_score", "experience_score", "education_score", "market_score")
_CHILD = {
    "education_count": r"(?:MSc|BSc|PhD|Diploma) in ",
    "experience_count": r"\([A-Z][a-z][a-z] [0-9][0-9][0-9][0-9] - ",
    "project_count": r"Project: ",
    "certification_count": r" Practitioner",
}


def child_counts(spark, sf) -> DataFrame:
    """Education, experience, project and certification entries of the resumes of each candidate (number at the end of doc_id)."""
    docs = table(spark, sf, "resume_document").select("doc_id", "raw_text").filter("raw_text IS NOT NULL").distinct()
    docs = docs.withColumn("candidate_id", F.regexp_extract("doc_id", r"_0*([0-9]+)$", 1).cast("long"))
    return docs.groupBy("candidate_id").agg(*[F.sum(F.regexp_count("raw_text", F.lit(p))).alias(n) for n, p in _CHILD.items()])


def role_skills(spark, sf) -> DataFrame:
    return m.taxonomy(spark, sf).filter((F.col("node_type") == "skill") & (F.col("industry_id") == m.INDUSTRY))


def latest_readiness(spark, sf):
    return m.latest_readiness(spark, sf).select("candidate_id", "id", "scored_at", *SCORES)


def dim_candidate(spark, sf):
    lr = m.latest_readiness(spark, sf).select("candidate_id", "scored_at", *SCORES)
    n = m.pairs(spark, sf).groupBy("candidate_id").agg(F.count("*").alias("total_skills_count"))
    c = m.candidates(spark, sf).withColumnRenamed("id", "candidate_id")
    zero = lambda x: F.coalesce(F.col(x), F.lit(0))
    return (
        c.join(lr, "candidate_id", "left").join(n, "candidate_id", "left").join(child_counts(spark, sf), "candidate_id", "left")
        .select(
            "candidate_id", F.col("full_name").alias("candidate_name"), "email", "location", "target_role_id", "seniority_band", "source",
            *[zero(s).alias(f"latest_{s}") for s in SCORES], F.col("scored_at").alias("latest_scored_at"),
            zero("total_skills_count").alias("total_skills_count"), *[zero(x).alias(x) for x in _CHILD], F.col("created_at").alias("candidate_created_at"),
        )
    )


def _per_role(spark, sf, rows: DataFrame, who: str, name: str) -> DataFrame:
    node = role_skills_any(spark, sf).select(F.col("id").alias("taxonomy_id"), "role_id")
    s = m.skills(spark, sf).join(node, "taxonomy_id").select(F.col("id").alias("skill_id"), "role_id")
    return rows.join(small(s), "skill_id").groupBy("role_id").agg(F.countDistinct(who).alias(name))


def role_skills_any(spark, sf) -> DataFrame:
    return m.taxonomy(spark, sf).filter("node_type = 'skill'")


def dim_role(spark, sf):
    tax = m.taxonomy(spark, sf)
    industry = tax.filter("node_type = 'industry'").groupBy("industry_id").agg(F.min_by("node_name", "id").alias("industry_name"))
    roles = tax.filter((F.col("node_type") == "role") & (F.col("industry_id") == m.INDUSTRY)).select("role_id", F.col("node_name").alias("role_name"), "industry_id").distinct()
    with_skills = _per_role(spark, sf, m.pairs(spark, sf), "candidate_id", "n_c")
    requiring = _per_role(spark, sf, m.job_skills(spark, sf), "job_id", "n_j")
    out = roles.join(industry, "industry_id", "left").join(with_skills, "role_id", "left").join(requiring, "role_id", "left")
    return out.select("role_id", "role_name", "industry_id", "industry_name", F.coalesce("n_c", F.lit(0)).alias("candidate_count_with_role_skills"), F.coalesce("n_j", F.lit(0)).alias("job_count_requiring_role_skills"))


def dim_skill(spark, sf):
    node = m.taxonomy(spark, sf).select(F.col("id").alias("taxonomy_id"), "category_id", "industry_id", "importance")
    nc = m.pairs(spark, sf).groupBy(F.col("skill_id").alias("id")).agg(F.count("*").alias("n_c"))
    nj = m.job_skills(spark, sf).groupBy(F.col("skill_id").alias("id")).agg(F.countDistinct("job_id").alias("n_j"))
    out = m.skills(spark, sf).join(node, "taxonomy_id", "left").join(nc, "id", "left").join(nj, "id", "left")
    return out.select(F.col("id").alias("skill_id"), "canonical_id", F.col("canonical_name").alias("skill_name"), "category_id", "industry_id", F.coalesce("n_c", F.lit(0)).alias("candidate_count"), F.coalesce("n_j", F.lit(0)).alias("job_count"), F.coalesce("importance", F.lit("medium")).alias("taxonomy_importance"))


def dim_date(spark, sf):
    at = F.col("scored_at")
    year, quarter = F.year(at), F.quarter(at)
    return table(spark, sf, "orders").select(F.col("o_orderdate").alias("scored_at")).distinct().select(
        F.to_date(at).alias("date_id"), "scored_at", year.alias("score_year"), F.month(at).alias("score_month"), quarter.alias("score_quarter"),
        F.concat(year, F.lit("-Q"), quarter).alias("year_quarter"), F.date_format(at, "yyyy-MM").alias("year_month"),
    )


def _fact(spark, sf) -> DataFrame:
    """Rows of the declared grain; ``copies`` is how often the joined grain repeats a row, once per requiring job."""
    c = m.candidates(spark, sf).select(F.col("id").alias("candidate_id"), F.col("target_role_id").alias("role_id"), "seniority_band", F.col("source").alias("candidate_source"))
    s = m.skills(spark, sf).select(F.col("id").alias("skill_id"), "canonical_id", F.col("canonical_name").alias("skill_name"))
    wanted = role_skills(spark, sf).select("role_id", F.col("skill_id").alias("canonical_id"), F.col("category_id").alias("skill_category"), F.col("importance").alias("skill_importance")).join(s, "canonical_id")
    market = m.job_skills(spark, sf).filter("is_required = 1").join(m.jobs(spark, sf).select("job_id", "role_id"), "job_id").select("role_id", "skill_id", "job_id")
    market = market.groupBy("role_id", "skill_id").agg(F.count("*").alias("n_jobs"))  # in the joined grain each job is a row
    wanted = wanted.join(market, ["role_id", "skill_id"], "left")
    have = m.pairs(spark, sf).withColumn("_has", F.lit(1))
    rows = c.join(small(wanted), "role_id").join(have, ["candidate_id", "skill_id"], "left").join(m.latest_readiness(spark, sf).select("candidate_id", "scored_at", *SCORES), "candidate_id", "left")
    has, need = F.coalesce("_has", F.lit(0)), F.when(F.col("n_jobs").isNotNull(), 1).otherwise(0)
    return rows.select(
        "candidate_id", "skill_id", "role_id", F.to_date("scored_at").alias("date_id"), has.alias("has_skill"), need.alias("is_required_by_market"), F.when((need == 1) & (has == 0), 1).otherwise(0).alias("gap_flag"),
        "skill_name", "skill_category", "skill_importance", *SCORES, "seniority_band", "candidate_source", "scored_at", F.greatest(F.coalesce("n_jobs", F.lit(1)), F.lit(1)).alias("copies"),
    )


def fact_candidate_match(spark, sf):
    return _fact(spark, sf).drop("copies")


def fact_candidate_match_joined(spark, sf):
    """In parity grain, as sums per (candidate, skill): the repeated rows carry nothing else, so they are counted, not written out."""
    return _fact(spark, sf).groupBy("candidate_id", "skill_id", "role_id").agg(*_weighted("n_rows", has_skill="has_skill", gap_hits="gap_flag"))


def _weighted(rows: str | None = None, **flags: str) -> list:
    """Number of rows and sums of flags, each row counted as often as the joined grain repeats it."""
    counted = [F.sum("copies").alias(rows)] if rows else []
    return counted + [F.sum(F.col(c) * F.col("copies")).alias(n) for n, c in flags.items()]


def skill_popularity(spark, sf):
    n = m.pairs(spark, sf).groupBy(F.col("skill_id").alias("id")).agg(F.count("*").alias("candidate_count"))
    node = m.taxonomy(spark, sf).select(F.col("id").alias("taxonomy_id"), "category_id")
    rows = small(m.skills(spark, sf)).join(n, "id").join(node, "taxonomy_id", "left")
    return rows.select("canonical_id", "canonical_name", "category_id", "candidate_count").orderBy(F.desc("candidate_count"), "canonical_id", "canonical_name").limit(20)


def role_requirements(spark, sf):
    return role_skills(spark, sf).select("role_id", F.col("node_name").alias("role_name"), "category_id", "skill_id", "importance").orderBy("role_id", m.importance_rank(F.col("importance")), "skill_id")


def importance_rank(spark, sf):
    return m.taxonomy(spark, sf).select("id", "importance", m.importance_rank(F.col("importance")).alias("rank"))


def candidates_per_role(spark, sf):
    n = m.pairs(spark, sf).groupBy(F.col("candidate_id").alias("id")).agg(F.count("*").alias("n"))
    rows = m.candidates(spark, sf).join(n, "id", "left")
    return rows.groupBy("target_role_id").agg(F.count("*").alias("candidate_count"), F.round(F.avg(F.coalesce("n", F.lit(0))), 1).alias("avg_skills_per_candidate"))


def top_candidates(spark, sf):
    node = m.taxonomy(spark, sf).select(F.col("id").alias("taxonomy_id"), "importance")
    s = m.skills(spark, sf).join(node, "taxonomy_id", "left").select(F.col("id").alias("skill_id"), "importance")
    per = m.pairs(spark, sf).join(small(s), "skill_id").groupBy("candidate_id").agg(F.count("*").alias("skills_count"), F.sum(F.when(F.col("importance") == "critical", 1).otherwise(0)).alias("critical_skills"))
    rows = m.candidates(spark, sf).select("id", "full_name", "target_role_id").join(per, F.col("id") == F.col("candidate_id"))
    return rows.select("id", "full_name", "target_role_id", "skills_count", "critical_skills").orderBy(F.desc("skills_count"), "id").limit(10)


def _gap(spark, sf) -> DataFrame:
    c = m.candidates(spark, sf).select(F.col("id").alias("candidate_id"), F.col("target_role_id").alias("role_id"))
    total = c.groupBy("role_id").agg(F.count("*").alias("total_role_candidates"))
    have = m.pairs(spark, sf).join(c, "candidate_id").groupBy("role_id", F.col("skill_id").alias("id")).agg(F.count("*").alias("have"))
    node = role_skills(spark, sf).select("role_id", F.col("skill_id").alias("canonical_id"), "importance")
    rows = node.join(m.skills(spark, sf).select("id", "canonical_id", "canonical_name"), "canonical_id").join(small(total), "role_id", "left").join(have, ["role_id", "id"], "left")
    n = F.coalesce("total_role_candidates", F.lit(0))
    return rows.select("role_id", F.col("canonical_id").alias("skill_id"), "canonical_name", "importance", (n - F.coalesce("have", F.lit(0))).alias("candidates_missing_skill"), n.alias("total_role_candidates"))


def skill_gap(spark, sf):
    """With the role, so that rows of a skill that several roles list can be told apart."""
    return _gap(spark, sf).orderBy(F.desc("candidates_missing_skill"), m.importance_rank(F.col("importance")), "role_id", "skill_id", "canonical_name").limit(15)


def fact_preview(spark, sf):
    f = _fact(spark, sf).groupBy("role_id", "skill_name").agg(*_weighted(candidates_with_skill="has_skill", market_required_hits="is_required_by_market", gap_hits="gap_flag"))
    return f.orderBy(F.desc("gap_hits"), "role_id", "skill_name").limit(15)


def recommendations(spark, sf):
    """One per candidate and missing role skill, with the importance of the gap as priority."""
    f = _fact(spark, sf).filter("has_skill = 0")
    return f.select("candidate_id", "skill_id", F.lit("skill_gap").alias("rec_type"), F.coalesce("skill_importance", F.lit("medium")).alias("priority"))


def readiness_trend(spark, sf):
    return m.readiness(spark, sf).groupBy(F.date_format("scored_at", "yyyy-MM").alias("year_month")).agg(F.count("*").alias("n"), F.round(F.avg("readiness_score"), 4).alias("avg_readiness"))


def readiness_leaderboard(spark, sf):
    c = m.candidates(spark, sf).select(F.col("id").alias("candidate_id"), F.col("target_role_id").alias("role_id"))
    rows = m.latest_readiness(spark, sf).select("candidate_id", "readiness_score").join(c, "candidate_id")
    rank = F.row_number().over(W.partitionBy("role_id").orderBy(F.desc("readiness_score"), "candidate_id"))
    return rows.withColumn("rank", rank).filter("rank <= 10").select("role_id", "candidate_id", "readiness_score", "rank")


def readiness_score(spark, sf):
    return m.readiness(spark, sf).select("id", "candidate_id", *SCORES)


def _masks(rows: DataFrame, keys: list[str], words: int, name: str, *more) -> DataFrame:
    """One row per ``keys`` with its column ``bit`` as a set of ``words`` 64-bit masks."""
    of = lambda i: F.when(F.floor(F.col("bit") / 64) == i, F.expr("shiftleft(1L, CAST(bit % 64 AS INT))")).otherwise(F.lit(0).cast("long"))
    return rows.groupBy(*keys).agg(*[F.bit_or(of(i)).alias(f"{name}{i}") for i in range(words)], *more)


#: Candidates and postings of a task of :func:`match_results`. Few candidates make their column of the result narrow: it has a dictionary per file.
TILE = (4096, 16384)


def _overlaps(words: int):
    """Maps blocks of masks to ``(job_id, skill_overlap_pct, missing_skill_count, ids)``: the candidates that share as many skills with a posting."""

    def score(batches):
        import numpy as np
        import pyarrow as pa

        for l, r in ((x.values, y.values) for b in batches for x, y in zip(b["l"], b["r"])):
            masks = lambda of, name: [of.field(f"{name}{i}").to_numpy().view(np.uint64) for i in range(words)]
            have, want, need = masks(l, "_c"), masks(r, "_j"), r.field("n_required").to_numpy()
            step, kind = max(1, (1 << 16) // len(l)), np.uint8 if need.max() < 256 else np.uint16
            for at in range(0, len(r), step):
                n = sum(np.bitwise_count(w[at : at + step, None] & h).astype(kind, copy=False) for h, w in zip(have, want))
                order = np.argsort(n, axis=1, kind="stable")
                n = np.take_along_axis(n, order, 1)
                job, _ = some = np.nonzero(n)
                if not len(job):
                    continue
                n = n[some]
                first = np.flatnonzero(np.diff(job, prepend=-1) | np.diff(n.astype(np.int32), prepend=-1))
                job, n = job[first] + at, n[first].astype(np.int64)
                # half up to two places in whole numbers
                pct = (20000 * n + need[job]) // (2 * need[job]) / 100
                ids = pa.ListArray.from_arrays(pa.array(np.append(first, len(some[0])), pa.int32()), l.field("candidate_id").take(pa.array(order[some])))
                yield pa.RecordBatch.from_arrays([r.field("job_id").take(pa.array(job)), pa.array(pct), pa.array(need[job] - n), ids], ["job_id", "skill_overlap_pct", "missing_skill_count", "ids"])

    return score


def match_results(spark, sf):
    """Overlap of each candidate with each posting of the target role that shares a required skill.

    Skill sets become bit masks over the skills that the role's postings require, and blocks of candidates meet
    blocks of postings, so that a pair is made where it is written and never moved, and no block is written twice.
    Rows of a posting with the same overlap follow one another, which keeps the written result small.
    """
    # required skills are distinct in a posting and ids in the skills, so the pairs are distinct as they are
    wants = m.jobs(spark, sf).select("job_id", "role_id", F.explode("required").alias("canonical_id")).dropna()
    need = wants.join(small(m.skills(spark, sf).select("canonical_id", F.col("id").alias("skill_id"))), "canonical_id").select("job_id", "role_id", "skill_id")
    bits = cut(need.select("role_id", "skill_id").distinct().withColumn("bit", F.row_number().over(W.partitionBy("role_id").orderBy("skill_id")) - 1))
    words = (bits.agg(F.max("bit")).first()[0] or 0) // 64 + 1
    bits = small(bits)
    c = m.candidates(spark, sf).select(F.col("id").alias("candidate_id"), F.col("target_role_id").alias("role_id"))
    have = table(spark, sf, "candidate_skills").select("candidate_id", "skill_id").dropna().join(c, "candidate_id").join(bits, ["role_id", "skill_id"])  # a mask takes repeated rows
    left = _masks(have, ["candidate_id", "role_id"], words, "_c")
    right = _masks(need.join(bits, ["role_id", "skill_id"]), ["job_id", "role_id"], words, "_j", F.count("*").alias("n_required"))
    counts = table(spark, sf, "candidates").count(), table(spark, sf, "synthetic_jd").count()
    blocks = tiled(left, right, "role_id", ("candidate_id", "job_id"), counts, TILE).select("l", "r")
    out = blocks.mapInArrow(_overlaps(words), "job_id string, skill_overlap_pct double, missing_skill_count long, ids array<long>")
    return out.select(F.explode("ids").alias("candidate_id"), "job_id", "skill_overlap_pct", "missing_skill_count")


NAMES = (
    "latest_readiness dim_candidate dim_role dim_skill dim_date fact_candidate_match fact_candidate_match_joined skill_popularity role_requirements importance_rank "
    "candidates_per_role top_candidates skill_gap fact_preview recommendations readiness_trend readiness_leaderboard readiness_score match_results"
).split()


def queries() -> dict:
    return {n: globals()[n] for n in NAMES}


_RANK = "CASE importance WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 WHEN 'low' THEN 4 ELSE 0 END"
_LATEST = ", ".join(f"coalesce(lr.{s}, 0) AS latest_{s}" for s in SCORES)
_LR = ", ".join(f"lr.{s}" for s in SCORES)
_FACT = f"""FROM cand c JOIN role_skill st ON st.role_id = c.target_role_id JOIN sk s ON s.canonical_id = st.skill_id LEFT JOIN lr ON lr.candidate_id = c.id
LEFT JOIN cs ON cs.candidate_id = c.id AND cs.skill_id = s.id"""
_MARKET = "LEFT JOIN (SELECT {d} js.skill_id, j.role_id FROM jskills js JOIN job j USING (job_id) WHERE js.is_required = 1) mk ON mk.skill_id = s.id AND mk.role_id = c.target_role_id"
_FLAGS = "CASE WHEN cs.skill_id IS NOT NULL THEN 1 ELSE 0 END AS has_skill, CASE WHEN mk.skill_id IS NOT NULL THEN 1 ELSE 0 END AS is_required_by_market, CASE WHEN mk.skill_id IS NOT NULL AND cs.skill_id IS NULL THEN 1 ELSE 0 END AS gap_flag"
_JOINED = f"(SELECT c.id AS candidate_id, s.id AS skill_id, c.target_role_id AS role_id, s.canonical_name AS skill_name, {_FLAGS} {_FACT} {_MARKET.format(d='')})"


def oracle_sql() -> dict[str, str]:
    q = {
        "latest_readiness": f"SELECT candidate_id, id, scored_at, {', '.join(SCORES)} FROM lr",
        "dim_candidate": f"""SELECT c.id AS candidate_id, full_name AS candidate_name, email, location, target_role_id, seniority_band, source, {_LATEST}, lr.scored_at AS latest_scored_at,
coalesce(n.n, 0) AS total_skills_count, {", ".join(f"coalesce(k.{x}, 0) AS {x}" for x in _CHILD)}, c.created_at AS candidate_created_at FROM cand c LEFT JOIN lr ON lr.candidate_id = c.id
LEFT JOIN (SELECT candidate_id, count(*) AS n FROM cs GROUP BY 1) n ON n.candidate_id = c.id
LEFT JOIN (SELECT try_cast(regexp_extract(doc_id, '_0*([0-9]+)$', 1) AS BIGINT) AS candidate_id, {", ".join(f"CAST(sum(len(regexp_extract_all(raw_text, '{p}'))) AS BIGINT) AS {x}" for x, p in _CHILD.items())}
  FROM (SELECT DISTINCT doc_id, raw_text FROM resume_document WHERE raw_text IS NOT NULL) GROUP BY 1) k ON k.candidate_id = c.id""",
        "dim_role": f"""SELECT DISTINCT st.role_id, st.node_name AS role_name, st.industry_id, (SELECT min_by(node_name, id) FROM tax i WHERE i.node_type = 'industry' AND i.industry_id = st.industry_id) AS industry_name,
(SELECT count(DISTINCT cs.candidate_id) FROM cs JOIN sk s ON s.id = cs.skill_id JOIN tax t ON t.id = s.taxonomy_id AND t.node_type = 'skill' WHERE t.role_id = st.role_id) AS candidate_count_with_role_skills,
(SELECT count(DISTINCT js.job_id) FROM jskills js JOIN sk s ON s.id = js.skill_id JOIN tax t ON t.id = s.taxonomy_id AND t.node_type = 'skill' WHERE t.role_id = st.role_id) AS job_count_requiring_role_skills
FROM tax st WHERE st.node_type = 'role' AND st.industry_id = '{m.INDUSTRY}'""",
        "dim_skill": """SELECT s.id AS skill_id, s.canonical_id, s.canonical_name AS skill_name, t.category_id, t.industry_id, (SELECT count(DISTINCT candidate_id) FROM cs WHERE cs.skill_id = s.id) AS candidate_count,
(SELECT count(DISTINCT job_id) FROM jskills js WHERE js.skill_id = s.id) AS job_count, coalesce(t.importance, 'medium') AS taxonomy_importance FROM sk s LEFT JOIN tax t ON t.id = s.taxonomy_id""",
        "dim_date": """SELECT DISTINCT CAST(scored_at AS DATE) AS date_id, scored_at, CAST(year(scored_at) AS INT) AS score_year, CAST(month(scored_at) AS INT) AS score_month, CAST(quarter(scored_at) AS INT) AS score_quarter,
year(scored_at) || '-Q' || quarter(scored_at) AS year_quarter, strftime(scored_at, '%Y-%m') AS year_month FROM cr""",
        "fact_candidate_match": f"""SELECT c.id AS candidate_id, s.id AS skill_id, c.target_role_id AS role_id, CAST(lr.scored_at AS DATE) AS date_id, {_FLAGS}, s.canonical_name AS skill_name, st.category_id AS skill_category,
st.importance AS skill_importance, {_LR}, c.seniority_band, c.source AS candidate_source, lr.scored_at {_FACT} {_MARKET.format(d="DISTINCT")}""",
        "fact_candidate_match_joined": f"SELECT candidate_id, skill_id, role_id, count(*) AS n_rows, CAST(sum(has_skill) AS BIGINT) AS has_skill, CAST(sum(gap_flag) AS BIGINT) AS gap_hits FROM {_JOINED} GROUP BY 1, 2, 3",
        "skill_popularity": """SELECT s.canonical_id, s.canonical_name, t.category_id, count(DISTINCT cs.candidate_id) AS candidate_count FROM sk s JOIN cs ON cs.skill_id = s.id LEFT JOIN tax t ON t.id = s.taxonomy_id
GROUP BY s.id, 1, 2, 3 ORDER BY candidate_count DESC, 1, 2 LIMIT 20""",
        "role_requirements": "SELECT role_id, node_name AS role_name, category_id, skill_id, importance FROM role_skill",
        "importance_rank": f"SELECT id, importance, CAST({_RANK} AS BIGINT) AS rank FROM tax",
        "candidates_per_role": "SELECT target_role_id, count(*) AS candidate_count, round(avg(coalesce(n, 0)), 1) AS avg_skills_per_candidate FROM cand LEFT JOIN (SELECT candidate_id, count(*) AS n FROM cs GROUP BY 1) x ON x.candidate_id = id GROUP BY 1",
        "top_candidates": """SELECT c.id, c.full_name, c.target_role_id, count(*) AS skills_count, CAST(sum(CASE WHEN t.importance = 'critical' THEN 1 ELSE 0 END) AS BIGINT) AS critical_skills
FROM cand c JOIN cs ON cs.candidate_id = c.id JOIN sk s ON s.id = cs.skill_id LEFT JOIN tax t ON t.id = s.taxonomy_id GROUP BY 1, 2, 3 ORDER BY skills_count DESC, 1 LIMIT 10""",
        "skill_gap": f"""SELECT st.role_id, st.skill_id, s.canonical_name, st.importance, (SELECT count(*) FROM cand c WHERE c.target_role_id = st.role_id) - (SELECT count(*) FROM cand c JOIN cs ON cs.candidate_id = c.id WHERE c.target_role_id = st.role_id AND cs.skill_id = s.id) AS candidates_missing_skill,
(SELECT count(*) FROM cand c WHERE c.target_role_id = st.role_id) AS total_role_candidates FROM role_skill st JOIN sk s ON s.canonical_id = st.skill_id ORDER BY candidates_missing_skill DESC, {_RANK.replace("importance", "st.importance")}, 1 NULLS FIRST, 2, 3 LIMIT 15""",
        "fact_preview": f"SELECT role_id, skill_name, CAST(sum(has_skill) AS BIGINT) AS candidates_with_skill, CAST(sum(is_required_by_market) AS BIGINT) AS market_required_hits, CAST(sum(gap_flag) AS BIGINT) AS gap_hits FROM {_JOINED} GROUP BY 1, 2 ORDER BY gap_hits DESC, 1, 2 LIMIT 15",
        "recommendations": f"SELECT c.id AS candidate_id, s.id AS skill_id, 'skill_gap' AS rec_type, coalesce(st.importance, 'medium') AS priority {_FACT} WHERE cs.skill_id IS NULL",
        "readiness_trend": "SELECT strftime(scored_at, '%Y-%m') AS year_month, count(*) AS n, round(avg(readiness_score), 4) AS avg_readiness FROM cr GROUP BY 1",
        "readiness_leaderboard": "SELECT * FROM (SELECT target_role_id AS role_id, candidate_id, readiness_score, CAST(row_number() OVER (PARTITION BY target_role_id ORDER BY readiness_score DESC, candidate_id) AS INT) AS rank FROM lr JOIN cand c ON c.id = candidate_id) WHERE rank <= 10",
        "readiness_score": f"SELECT id, candidate_id, {', '.join(SCORES)} FROM cr",
        "match_results": """SELECT h.candidate_id, h.job_id, round(100.0 * n_shared / n_required, 2) AS skill_overlap_pct, n_required - n_shared AS missing_skill_count
FROM (SELECT cs.candidate_id, js.job_id, count(*) AS n_shared FROM cs JOIN cand c ON c.id = cs.candidate_id JOIN jskills js ON js.skill_id = cs.skill_id AND js.is_required = 1 JOIN job j ON j.job_id = js.job_id AND j.role_id = c.target_role_id GROUP BY 1, 2) h
JOIN (SELECT job_id, count(*) AS n_required FROM jskills WHERE is_required = 1 GROUP BY 1) n USING (job_id)""",
    }
    return {k: m.MODEL_SQL + v for k, v in q.items()}
