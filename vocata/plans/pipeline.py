"""Document, write and quality queries over the project's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import extract as x
from ..functions import text as t
from ..operators import documents as d
from ..operators import evaluate, merge, quality, similarity
from ..session import table, table_names
from . import model as m
from . import text_sql

TABLES = ("skill_taxonomy", "skills", "skill_alias", "candidates", "candidate_skills", "resume_document", "raw_jd", "skill_hits", "synthetic_resume", "synthetic_jd")


def _resumes(s, sf):
    return d.document_lines(table(s, sf, "resume_document"), "doc_id", "raw_text")


def _adverts(s, sf):
    return d.document_lines(table(s, sf, "raw_jd"), "jd_id", "raw_text")


def _index(s, sf):
    return d.skill_index(m.skills(s, sf), m.aliases(s, sf))


def _texts(s, sf):
    """Every text of adverts and resumes once."""
    adverts = table(s, sf, "raw_jd").select(F.col("jd_id").alias("doc_id"), "raw_text")
    return adverts.unionByName(table(s, sf, "resume_document").select("doc_id", "raw_text")).filter("raw_text IS NOT NULL").distinct()


def _over(column):
    return lambda s, sf: _texts(s, sf).select("doc_id", F.sha2(column(F.col("raw_text")), 256).alias("out"))


clean_punct, clean_bullets, ascii_fold = _over(t.clean_punct), _over(t.clean_bullets), _over(t.ascii_fold)
dehyphenate, collapse_ws, clean_document = _over(t.dehyphenate), _over(t.collapse_ws), _over(t.clean_document)


def content_hash(s, sf):
    return _texts(s, sf).select("doc_id", t.content_hash(F.col("doc_id")).alias("content_hash"))


def block_kind(s, sf):
    return _resumes(s, sf).groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


def doc_lines(s, sf):
    return d.document_lines(_texts(s, sf), "doc_id", "raw_text").groupBy("doc_id").agg(F.count("*").alias("n_lines"))


def scrub_pii(s, sf):
    return t.scrub(_texts(s, sf), "raw_text").select("doc_id", "scrubbed")


def scrub_pii_counts(s, sf):
    return t.scrub(_texts(s, sf), "raw_text").select("doc_id", *[k for k, _ in t.SCRUB])


def segment_sections(s, sf):
    return d.segment(_resumes(s, sf)).groupBy("doc_id", "section").agg(F.count("*").alias("n_lines"))


def segment_jd(s, sf):
    return d.segment_jd(_adverts(s, sf)).groupBy("doc_id", "section").agg(F.count("*").alias("n_lines"))


def skill_index(s, sf):
    return _index(s, sf)


def skill_match(s, sf):
    rows = d.segment_jd(_adverts(s, sf)).filter(F.col("section").isin("responsibilities", "requirements", "preferred"))
    return d.match_skills(rows, _index(s, sf))


def jd_skills(s, sf):
    return d.jd_skills(skill_match(s, sf))


def resume_skills(s, sf):
    rows = d.segment(_resumes(s, sf)).filter(F.col("section").isin("skills", "experience", "projects"))
    return d.resume_skills(d.match_skills(rows, _index(s, sf)))


def _header(s, sf):
    docs = table(s, sf, "resume_document").select("doc_id", "raw_text").dropna().distinct()
    return docs.select("doc_id", "raw_text")


def extract_email(s, sf):
    return _header(s, sf).select("doc_id", x.email(F.col("raw_text")).alias("email"))


def extract_phone(s, sf):
    return _header(s, sf).select("doc_id", x.phone(F.col("raw_text")).alias("phone"))


def extract_location(s, sf):
    return _header(s, sf).select("doc_id", x.location(F.col("raw_text")).alias("location"))


def extract_name(s, sf):
    first = F.try_element_at(F.filter(t.lines(F.col("raw_text")), lambda v: x.strip(v) != ""), F.lit(1))
    return _header(s, sf).select("doc_id", x.name(first).alias("name"))


def extract_education(s, sf):
    return d.education_entries(d.segment(_resumes(s, sf)))


def extract_dates(s, sf):
    return _resumes(s, sf).select("doc_id", "pos", x.dates(F.col("text")).alias("r")).filter("r IS NOT NULL").select("doc_id", "pos", "r.*")


def extract_experience(s, sf):
    return d.experience_entries(d.segment(_resumes(s, sf)))


def extract_projects(s, sf):
    return d.project_entries(d.segment(_resumes(s, sf)))


def extract_certs(s, sf):
    return d.certificate_entries(d.segment(_resumes(s, sf)))


def split_title_company(s, sf):
    lines = d.title_lines(d.segment(_resumes(s, sf)))
    return lines.select("doc_id", "pos", x.title_company(F.col("text")).alias("r")).select("doc_id", "pos", "r.*")


def parse_month_date(s, sf):
    """Month and year, a bare year, an unknown month, and what is no date."""
    at = F.col("o_orderdate")
    forms = F.array(F.date_format(at, "MMM yyyy"), F.date_format(at, "yyyy"), F.concat(F.lit("Xyz "), F.date_format(at, "yyyy")), F.col("o_orderpriority"))
    shown = table(s, sf, "orders").select(F.explode(forms).alias("text")).distinct()
    return shown.select("text", t.month_date(F.col("text")).alias("day"))


def resume_month_dates(s, sf):
    """The starts and ends of the date ranges of the resumes, as days; ends such as Present have none."""
    ends = extract_dates(s, sf).select("doc_id", "pos", F.explode(F.create_map(F.lit("start"), "start", F.lit("end"), "end")).alias("edge", "text"))
    return ends.withColumn("day", t.month_date(F.col("text")))


def jd_header(s, sf):
    return d.jd_header(d.segment_jd(_adverts(s, sf)))


def jd_years(s, sf):
    """Years asked for in each line of an advert that names some."""
    return _adverts(s, sf).select("doc_id", "pos", x.years(F.col("text")).alias("years")).filter("years IS NOT NULL")


def jd_text_years(s, sf):
    """The least number of years in the requirement lines of each advert, null if they name none."""
    years = F.min(F.when(F.col("section") == "requirements", x.years(F.col("text"))))
    return d.segment_jd(_adverts(s, sf)).groupBy("doc_id").agg(years.alias("years_min"))


def jd_seniority(s, sf):
    """From the title line and the requirement lines of each advert."""
    rows = jd_header(s, sf).join(jd_text_years(s, sf), "doc_id")
    return rows.select("doc_id", "job_title", "years_min", x.seniority(F.col("job_title"), F.col("years_min")).alias("seniority"))


def jd_role(s, sf):
    """Role of each title by the hints of the engine, and by hints given for the roles of these tables."""
    given = {"revenue": "revenue_analyst", "pipeline": "pipeline_engineer", "model": "model_engineer"}
    title = F.col("job_title")
    return jd_header(s, sf).select("doc_id", x.role(title).alias("role_id"), x.role(title, given).alias("given_role_id"))


def jd_bullets(s, sf):
    """Responsibilities and requirements of each advert without their bullet signs."""
    rows = d.segment_jd(_adverts(s, sf)).filter(F.col("section").isin("responsibilities", "requirements"))
    return rows.select("doc_id", "section", "pos", x.bullet_text(F.col("text")).alias("text"))


def project_skills(s, sf):
    """Skills of each project as a JSON array, as the last line of its text names them."""
    return d.project_skills(d.segment(_resumes(s, sf)), _index(s, sf))


def _parsed(s, sf):
    return d.parse_resume(_resumes(s, sf), _index(s, sf))


def parse_resume(s, sf):
    """The entries as JSON, so that one row holds all of a resume."""
    kinds = ("education", "experience", "projects", "certifications")
    return _parsed(s, sf).withColumns({k: F.concat_ws("\n", F.transform(k, lambda e: F.to_json(e))) for k in ("projects", "certifications")}).drop(*kinds[:2])


def parse_entries(s, sf):
    """Education and experience entries that a parse holds, one row each."""
    p = _parsed(s, sf)
    none, text = F.lit(None).cast("string"), lambda c: F.col(c).cast("string")
    edu = p.select("doc_id", F.explode("education").alias("e")).select("doc_id", F.lit("education").alias("kind"), F.col("e.degree").alias("a"), F.col("e.institution").alias("b"), text("e.year").alias("c"), F.lit(0).alias("n_bullets"))
    exp = p.select("doc_id", F.explode("experience").alias("e")).select("doc_id", F.lit("experience").alias("kind"), F.col("e.title").alias("a"), F.col("e.company").alias("b"), F.coalesce("e.start", none).alias("c"), F.size("e.bullets").alias("n_bullets"))
    return edu.unionByName(exp)


def parse_jd(s, sf):
    p = d.parse_jd(_adverts(s, sf), _index(s, sf))
    return p.withColumns({k: F.concat_ws("\n", k) for k in ("responsibilities", "requirements")})


def _truth(s, sf):
    lab = m.labels(s, sf)
    docs = table(s, sf, "resume_document").select(F.col("doc_id").alias("resume_id")).distinct()
    lab = lab.join(docs, "resume_id", "left_semi")
    return lab.select(F.col("resume_id").alias("doc_id"), F.explode("skills").alias("canonical_id")), lab.select(F.col("resume_id").alias("doc_id"), "role_id")


def _prf(s, sf):
    truth, roles = _truth(s, sf)
    hits = table(s, sf, "skill_hits").select("doc_id", "canonical_id").dropna()
    return evaluate.scores(hits, truth, roles)


def eval_prf(s, sf):
    """The delivered skill hits of resumes against their labels, per role."""
    return _prf(s, sf).filter("NOT overall").drop("overall")


def eval_prf_overall(s, sf):
    return _prf(s, sf).filter("overall").drop("overall", "role_id")


def eval_parse(s, sf):
    """The parser of this package against the labels."""
    truth, roles = _truth(s, sf)
    return evaluate.scores(resume_skills(s, sf).select("doc_id", "canonical_id"), truth, roles)


def eval_coverage(s, sf):
    p = _parsed(s, sf)
    share = lambda c: F.round(F.avg(c.cast("int")), 6)
    return p.agg(share(F.col("name").isNotNull()).alias("name"), share(F.col("n_education") > 0).alias("education"), share(F.col("n_experience") > 0).alias("experience"), share(F.col("n_projects") > 0).alias("projects"))


def load_summary(s, sf):
    p = _parsed(s, sf)
    return p.agg(F.count("*").alias("parsed"), F.sum(F.size("skills")).alias("skills"), F.sum("n_education").alias("education"), F.sum("n_experience").alias("experience"), F.sum("n_projects").alias("projects"), F.sum("n_certifications").alias("certifications"))


# taxonomy


def taxonomy_nodes(s, sf):
    return m.taxonomy(s, sf).select("id", "node_type", "industry_id", "role_id", "category_id", "skill_id", "node_name", "parent_id", "importance")


def skills_master(s, sf):
    nodes = m.taxonomy(s, sf).filter("node_type = 'skill' AND skill_id IS NOT NULL")
    return nodes.groupBy(F.col("skill_id").alias("canonical_id")).agg(F.min_by("node_name", "id").alias("canonical_name"), F.count("*").alias("n_nodes"))


def skill_alias(s, sf):
    return m.aliases(s, sf)


def skill_taxonomy_link(s, sf):
    first = m.taxonomy(s, sf).filter("node_type = 'skill'").groupBy(F.col("skill_id").alias("canonical_id")).agg(F.min("id").alias("taxonomy_id"))
    return m.skills(s, sf).select("id", "canonical_id").join(first, "canonical_id", "left").select("id", "taxonomy_id")


def taxonomy_violations(s, sf):
    return quality.taxonomy_violations(m.taxonomy(s, sf), table(s, sf, "skill_alias"))


def taxonomy_stats(s, sf):
    return quality.taxonomy_stats(m.taxonomy(s, sf))


# quality


def table_counts(s, sf):
    return quality.table_counts({n: table(s, sf, n) for n in TABLES})


def dq_missing_tables(s, sf):
    have = s.createDataFrame([(n,) for n in table_names(s, sf)], "table_name string")
    return quality.missing_tables(s, have, [*TABLES, "match_results", "career_readiness"])


def dq_orphans(s, sf):
    cs = table(s, sf, "candidate_skills")
    rows = lambda c, to: cs.filter(F.col(c).isNotNull()).join(table(s, sf, to).select(F.col("id").alias(c)), c, "left_anti").agg(F.count("*").alias("n")).select(F.lit(c).alias("reference"), "n")
    return rows("candidate_id", "candidates").unionByName(rows("skill_id", "skills"))


def dq_orphan_resumes(s, sf):
    """The third orphan count beside those of dq_orphans: resumes whose doc_id names no candidate."""
    number = F.regexp_extract("doc_id", r"_0*([0-9]+)$", 1).try_cast("long").alias("id")
    docs = table(s, sf, "resume_document").filter("doc_id IS NOT NULL").select("doc_id", number).distinct()
    return docs.join(table(s, sf, "candidates").select("id"), "id", "left_anti").agg(F.count("*").alias("n")).select(F.lit("resume_document").alias("reference"), "n")


def dq_no_resume(s, sf):
    got = table(s, sf, "resume_document").select(F.regexp_extract("doc_id", r"_0*([0-9]+)$", 1).cast("long").alias("id")).distinct()
    return m.candidates(s, sf).join(got, "id", "left_anti").select("id")


def dq_taxonomy_link(s, sf):
    return m.skills(s, sf).filter("taxonomy_id IS NOT NULL").join(m.taxonomy(s, sf).select(F.col("id").alias("taxonomy_id")), "taxonomy_id", "left_anti").select("id", "taxonomy_id")


def dq_email_domain(s, sf):
    """Candidates whose address is not on the domain that the loader writes."""
    return m.candidates(s, sf).filter("email NOT LIKE '%@postkorb.example'").select("id", "email")


def dq_reserved_rows(s, sf):
    """A check whose rule can never hold (an empty relation to the optimizer) beside one that can, as counts."""
    skills = m.skills(s, sf)
    none = skills.filter(F.lit(False)).agg(F.count("*").alias("n")).select(F.lit("never").alias("rule"), "n")
    return none.unionByName(skills.filter("taxonomy_id IS NULL").agg(F.count("*").alias("n")).select(F.lit("no_taxonomy").alias("rule"), "n"))


def dedup_exact(s, sf):
    return similarity.dedup_exact(table(s, sf, "documents"), "doc_id", "text").select(F.col("key").alias("doc_id"), "content_hash", "copy_no")


def match_tfidf(s, sf):
    c = m.labels(s, sf).select(F.col("resume_id").alias("id"), "role_id", F.col("skills").alias("terms"))
    j = m.jobs(s, sf).select(F.col("job_id").alias("id"), "role_id", F.col("required").alias("terms"))
    best = similarity.tfidf_best(c, j)
    return best.withColumnsRenamed({"left_id": "resume_id", "n_right": "n_jobs"})


# writes: the labels and adverts of the tables delivered to a store that holds the older part


def _store(s, sf):
    cols = ["id", "full_name", "email", "location", "target_role_id", "seniority_band"]
    every = m.candidates(s, sf).dropna(subset=["email"])
    old = merge.first_per_key(every.filter("created_at < timestamp'2023-01-01'"), ["email"], ["id"]).select(*cols)
    new = table(s, sf, "candidates").filter("updated_at >= timestamp'2023-01-01'").select(*cols)
    return old, new


def upsert_candidates(s, sf):
    old, new = _store(s, sf)
    return merge.upsert(old, new, ["email"], ["full_name", "target_role_id"], ["id", "full_name", "target_role_id", "location", "seniority_band"])


def insert_ignore_resumes(s, sf):
    docs = table(s, sf, "resume_document").filter("raw_text IS NOT NULL").select(F.sha2("doc_id", 256).alias("content_hash"), "doc_id", "source_path")
    old = merge.first_per_key(docs.filter("doc_id < 'p'"), ["content_hash"], ["source_path"])
    return merge.insert_ignore(old, docs, ["content_hash"], ["source_path", "doc_id"])


def link_candidate_skills(s, sf):
    lab = m.labels(s, sf).select(F.regexp_extract("resume_id", r"_0*([0-9]+)$", 1).cast("long").alias("candidate_id"), F.explode("skills").alias("canonical_id"))
    new = lab.join(m.skills(s, sf).select("canonical_id", F.col("id").alias("skill_id")), "canonical_id").select("candidate_id", "skill_id")
    return merge.insert_ignore(m.pairs(s, sf), new, ["candidate_id", "skill_id"], ["candidate_id"])


def replace_children(s, sf):
    old = m.pairs(s, sf)
    lab = m.labels(s, sf).select(F.regexp_extract("resume_id", r"_0*([0-9]+)$", 1).cast("long").alias("candidate_id"), F.explode("skills").alias("canonical_id"))
    new = lab.join(m.skills(s, sf).select("canonical_id", F.col("id").alias("skill_id")), "canonical_id").select("candidate_id", "skill_id").distinct()
    return merge.replace_children(old, new, "candidate_id")


def evidence_upgrade(s, sf):
    cs = table(s, sf, "candidate_skills").dropna(subset=["candidate_id", "skill_id", "evidence"]).select("candidate_id", "skill_id", "evidence", "source_section", "created_at")
    split = "timestamp'2022-01-01'"
    old = merge.first_per_key(cs.filter(f"created_at < {split}"), ["candidate_id", "skill_id"], ["evidence", "source_section"]).drop("created_at")
    new = cs.filter(f"NOT coalesce(created_at < {split}, false)").drop("created_at")  # rows without a date arrive with the new ones
    return merge.upgrade_evidence(old, new, ["candidate_id", "skill_id"])


def status_flip(s, sf):
    docs = table(s, sf, "resume_document").select("doc_id", "raw_text").groupBy("doc_id").agg(F.max(F.coalesce(F.length(x.strip(F.col("raw_text"))), F.lit(0))).alias("n"))
    pending = docs.select("doc_id", F.lit("pending").alias("parsed_status"))
    return merge.flip_status(pending, docs.filter("n > 0"), docs.filter("n = 0"), "doc_id")


def upsert_jobs(s, sf):
    j = m.jobs(s, sf).select(t.content_hash(F.col("job_id")).alias("content_hash"), "job_id", "job_title", "company", "role_id")
    old = j.filter("job_id < 'p'").withColumn("company", F.lit("Unknown"))
    return merge.upsert(old, j, ["content_hash"], ["job_title", "role_id"], ["job_id"])


def manifest_upsert(s, sf):
    """The manifest of the resume formats, replaced batch by batch where the adverts have one of the name."""
    count = lambda t: table(s, sf, t).filter("file_format IS NOT NULL").groupBy(F.lower("file_format").alias("batch")).agg(F.count("*").alias("n"))
    return merge.upsert(count("resume_document").withColumn("n", -F.col("n")), count("raw_jd"), ["batch"], ["n"], ["n"])


def _label_pairs(s, sf):
    lab = m.labels(s, sf).select("resume_id", F.explode("skills").alias("canonical_id"))
    return lab.join(m.skills(s, sf).select("canonical_id", F.col("id").alias("skill_id")), "canonical_id", "left")


def link_unknown_skills(s, sf):
    """Skills of labels that no skill row names: counted and left out when labels are linked."""
    return _label_pairs(s, sf).groupBy("canonical_id").agg(F.count_if(F.col("skill_id").isNull()).alias("unknown"), F.count_if(F.col("skill_id").isNotNull()).alias("linked"))


def replace_job_skills(s, sf):
    """Job skills after delivery of the adverts of the second half: theirs replaced as a whole, the others kept.

    The store holds the required skills alone; what is delivered brings preferred ones as well.
    """
    every = m.job_skills(s, sf).select("job_id", "skill_id", "importance", "is_required")
    return merge.replace_children(every.filter("is_required = 1"), every.filter("job_id >= 'p'"), "job_id")


def write_defaults(s, sf):
    """Values that are written where a candidate has none."""
    return m.candidates(s, sf).select("id", *[merge.or_default(F.col(c), v).alias(c) for c, v in (("full_name", "Unknown"), ("seniority_band", "fresher"), ("source", "synthetic"), ("location", None), ("phone", None))])


def parse_outcome(s, sf):
    """Every resume row with what became of it: a document that fails has an error and stops no other."""
    return d.parse_outcome(table(s, sf, "resume_document"), "doc_id", "raw_text")


def label_emails(s, sf):
    """The address that a candidate loaded from a label gets."""
    return m.labels(s, sf).select("resume_id", x.synthetic_email(F.col("resume_id")).alias("email"))


def lookup_candidates(s, sf):
    """Ids of candidates by address, for the addresses of all profiles at once instead of one by one."""
    asked = table(s, sf, "candidates").select(F.lower("email").alias("asked")).dropna().distinct()
    ids = merge.first_per_key(m.candidates(s, sf).select(F.lower("email").alias("asked"), "id"), ["asked"], ["id"])
    return asked.join(ids, "asked", "left").select("asked", "id")


def label_load(s, sf):
    return table(s, sf, "synthetic_resume").filter("coalesce(source, '') IN ('', 'synthetic_generator')").groupBy("target_role_id").agg(F.countDistinct("resume_id").alias("n"))


def synthetic_sample(s, sf, low: int = 60, span: int = 31):
    """Seeded sample of 60 to 90 % of the skills of each role, at least three, for ten resumes a role."""
    from pyspark.sql import Window as W

    nodes = m.taxonomy(s, sf).filter("node_type = 'skill' AND skill_id IS NOT NULL").select("role_id", "skill_id").distinct()
    n = nodes.groupBy("role_id").agg(F.count("*").alias("n"))
    docs = n.select("role_id", "n", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("doc_no"))
    share = low + F.conv(F.substring(F.md5(F.concat_ws("|", "role_id", F.col("doc_no").cast("string"))), 1, 6), 16, 10).cast("int") % span
    docs = docs.withColumn("k", F.greatest(F.lit(3), F.floor(F.col("n") * share / 100)))
    rank = F.row_number().over(W.partitionBy("role_id", "doc_no").orderBy(F.md5(F.concat_ws("|", "role_id", F.col("doc_no").cast("string"), "skill_id")), "skill_id"))
    return docs.join(nodes, "role_id").withColumn("r", rank).filter("r <= k").select("role_id", "doc_no", "skill_id")


def synthetic_jd_sample(s, sf):
    """As synthetic_sample, of 70 to 95 % for adverts."""
    return synthetic_sample(s, sf, 70, 26)


NAMES = (
    "parse_entries jd_bullets project_skills dq_reserved_rows link_unknown_skills replace_job_skills write_defaults parse_outcome label_emails lookup_candidates synthetic_jd_sample "
    "clean_punct clean_bullets ascii_fold dehyphenate collapse_ws clean_document content_hash block_kind doc_lines scrub_pii scrub_pii_counts segment_sections segment_jd skill_index skill_match jd_skills resume_skills "
    "extract_email extract_phone extract_location extract_name extract_education extract_dates extract_experience extract_projects extract_certs split_title_company parse_month_date resume_month_dates jd_header jd_years jd_text_years jd_seniority jd_role "
    "parse_resume parse_jd eval_prf eval_prf_overall eval_parse eval_coverage load_summary taxonomy_nodes skills_master skill_alias skill_taxonomy_link taxonomy_violations taxonomy_stats table_counts dq_missing_tables dq_orphans "
    "dq_orphan_resumes dq_no_resume dq_taxonomy_link dq_email_domain dedup_exact match_tfidf upsert_candidates insert_ignore_resumes link_candidate_skills replace_children evidence_upgrade status_flip upsert_jobs manifest_upsert label_load synthetic_sample"
).split()


def queries() -> dict:
    return {n: globals()[n] for n in NAMES}


_TEXTS = text_sql.TEXTS
_LINES = "(SELECT doc_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS text FROM (SELECT doc_id, string_split_regex(raw_text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]') AS l FROM {t}))"
_BLANK = "regexp_matches(text, '[^\\s\\p{Z}\\x0b\\x1c-\\x1f\\x{85}]')"
_TAXLINK = "(SELECT skill_id AS canonical_id, min(id) AS taxonomy_id FROM tax WHERE node_type = 'skill' GROUP BY 1)"
_PR = "CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall"
_EVAL = f"""ev AS (SELECT role_id, sum(p * t) AS tp, sum(p * (1 - t)) AS fp, sum((1 - p) * t) AS fn FROM (SELECT doc_id, canonical_id, max(p) AS p, max(t) AS t FROM (
  SELECT DISTINCT doc_id, canonical_id, 1 AS p, 0 AS t FROM skill_hits WHERE doc_id IS NOT NULL AND canonical_id IS NOT NULL UNION ALL SELECT resume_id, unnest(skills), 0, 1 FROM lab) GROUP BY 1, 2) b
  JOIN (SELECT resume_id, role_id FROM lab WHERE resume_id IN (SELECT doc_id FROM resume_document)) r ON r.resume_id = b.doc_id GROUP BY {{g}}),
pr AS (SELECT *, {_PR} FROM ev)
SELECT {{c}} CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1 FROM pr"""
_CID = "CAST(regexp_extract(resume_id, '_0*([0-9]+)$', 1) AS BIGINT)"
_LABELPAIR = f"(SELECT DISTINCT {_CID} AS candidate_id, sk.id AS skill_id FROM (SELECT resume_id, unnest(skills) AS canonical_id FROM lab) JOIN sk USING (canonical_id) WHERE regexp_matches(resume_id, '_0*[0-9]+$'))"


def _sample_sql(low: int, span: int) -> str:
    return f"""SELECT role_id, doc_no, skill_id FROM (SELECT role_id, doc_no, skill_id, greatest(3, floor(n * ({low} + CAST('0x' || substr(md5(role_id || '|' || doc_no), 1, 6) AS INT) % {span}) / 100)) AS k,
row_number() OVER (PARTITION BY role_id, doc_no ORDER BY md5(role_id || '|' || doc_no || '|' || skill_id), skill_id) AS r FROM (SELECT DISTINCT role_id, skill_id FROM tax WHERE node_type = 'skill' AND skill_id IS NOT NULL)
JOIN (SELECT role_id, count(DISTINCT skill_id) AS n FROM tax WHERE node_type = 'skill' AND skill_id IS NOT NULL GROUP BY 1) USING (role_id) CROSS JOIN (SELECT unnest(range(10))::INT AS doc_no)) WHERE r <= k"""


_EV = "SELECT candidate_id, skill_id, struct_pack(evidence := evidence, source_section := source_section) AS {n} FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id, skill_id ORDER BY {o}) AS rn FROM candidate_skills WHERE candidate_id IS NOT NULL AND skill_id IS NOT NULL AND evidence IS NOT NULL AND {w}) WHERE rn = 1"
_BEFORE = "coalesce(created_at < TIMESTAMP '2022-01-01', false)"
_EVIDENCE = f"ev_old AS ({_EV.format(n='o', o='evidence NULLS LAST, source_section NULLS LAST', w=_BEFORE)}), ev_new AS ({_EV.format(n='n', o="CASE WHEN evidence = 'explicit' THEN 0 ELSE 1 END, source_section NULLS LAST", w='NOT ' + _BEFORE)})"
_TFIDF = """lt AS (SELECT DISTINCT resume_id AS id, role_id, unnest(skills) AS term FROM lab), rt AS (SELECT DISTINCT job_id AS id, role_id, unnest(required) AS term FROM job),
ds AS (SELECT DISTINCT 'l:' || id AS d, term FROM lt UNION SELECT 'r:' || id, term FROM rt), idf AS (SELECT term, ln(1 + (SELECT count(DISTINCT d) FROM ds) / count(*)) AS w FROM ds GROUP BY 1),
lw AS (SELECT * FROM lt JOIN idf USING (term)), rw AS (SELECT * FROM rt JOIN idf USING (term))"""
_MORE = {"evidence_upgrade": _EVIDENCE, "match_tfidf": _TFIDF}


def oracle_sql() -> dict[str, str]:
    q = {
        "clean_punct": f"SELECT doc_id, sha256(translate(raw_text, '—–’‘“”�•', '--''''\"\"- ')) AS out FROM {_TEXTS}",
        "clean_bullets": f"SELECT doc_id, sha256(regexp_replace(raw_text, '[•▪●◦⁃*]', ' ', 'g')) AS out FROM {_TEXTS}",
        "content_hash": f"SELECT doc_id, sha256(doc_id) AS content_hash FROM {_TEXTS}",
        "doc_lines": f"SELECT doc_id, count(*) AS n_lines FROM {_LINES.replace("{t}", _TEXTS)} WHERE {_BLANK} GROUP BY 1",
        "taxonomy_nodes": "SELECT id, node_type, industry_id, role_id, category_id, skill_id, node_name, parent_id, importance FROM tax",
        "skills_master": "SELECT skill_id AS canonical_id, min_by(node_name, id) AS canonical_name, count(*) AS n_nodes FROM tax WHERE node_type = 'skill' AND skill_id IS NOT NULL GROUP BY 1",
        "skill_alias": "SELECT id, alias_text, lower(trim(alias_text, ' ')) AS alias_text_norm, skill_id FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(alias_text, ' ')) ORDER BY id NULLS LAST, skill_id) AS rn FROM skill_alias WHERE skill_id IS NOT NULL AND alias_text IS NOT NULL) WHERE rn = 1",
        "skill_taxonomy_link": f"SELECT sk.id, l.taxonomy_id FROM sk LEFT JOIN {_TAXLINK} l USING (canonical_id)",
        "taxonomy_stats": "SELECT industry_id, node_type, count(*) AS n_nodes, count(DISTINCT skill_id) AS n_skills FROM tax GROUP BY 1, 2",
        "taxonomy_violations": """SELECT DISTINCT * FROM (SELECT 'importance' AS rule, CAST(id AS VARCHAR) AS subject FROM tax WHERE node_type = 'skill' AND importance NOT IN ('critical', 'high', 'medium', 'low')
UNION ALL SELECT 'importance_missing', CAST(id AS VARCHAR) FROM tax WHERE node_type = 'skill' AND importance IS NULL UNION ALL SELECT 'skill_id_missing', CAST(id AS VARCHAR) FROM tax WHERE node_type = 'skill' AND skill_id IS NULL
UNION ALL SELECT 'parent_missing', CAST(id AS VARCHAR) FROM tax WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT id FROM tax) UNION ALL SELECT 'two_names', skill_id FROM tax WHERE node_type = 'skill' GROUP BY skill_id HAVING count(DISTINCT lower(node_name)) > 1
UNION ALL SELECT 'alias_of_two', lower(trim(alias_text, ' ')) FROM skill_alias WHERE skill_id IS NOT NULL GROUP BY 2 HAVING count(DISTINCT skill_id) > 1 UNION ALL SELECT 'thin_role', role_id FROM tax WHERE node_type = 'skill' GROUP BY industry_id, role_id HAVING count(DISTINCT skill_id) < 5)""",
        "table_counts": " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n_rows FROM {n}" for n in TABLES),
        "dq_missing_tables": f"SELECT * FROM (SELECT unnest({[*TABLES, 'match_results', 'career_readiness']}) AS table_name) WHERE table_name NOT IN (SELECT table_name FROM information_schema.tables)",
        "dq_orphans": "SELECT 'candidate_id' AS reference, count(*) AS n FROM candidate_skills WHERE candidate_id IS NOT NULL AND candidate_id NOT IN (SELECT id FROM candidates WHERE id IS NOT NULL) UNION ALL SELECT 'skill_id', count(*) FROM candidate_skills WHERE skill_id IS NOT NULL AND skill_id NOT IN (SELECT id FROM skills WHERE id IS NOT NULL)",
        "dq_orphan_resumes": "SELECT 'resume_document' AS reference, count(*) AS n FROM (SELECT DISTINCT doc_id, TRY_CAST(regexp_extract(doc_id, '_0*([0-9]+)$', 1) AS BIGINT) AS cid FROM resume_document WHERE doc_id IS NOT NULL) r WHERE NOT EXISTS (SELECT 1 FROM candidates c WHERE c.id = r.cid)",
        "dq_no_resume": "SELECT id FROM cand WHERE id NOT IN (SELECT CAST(regexp_extract(doc_id, '_0*([0-9]+)$', 1) AS BIGINT) FROM resume_document WHERE regexp_matches(doc_id, '_0*[0-9]+$'))",
        "dq_taxonomy_link": "SELECT id, taxonomy_id FROM sk WHERE taxonomy_id IS NOT NULL AND taxonomy_id NOT IN (SELECT id FROM tax)",
        "dq_email_domain": "SELECT id, email FROM cand WHERE email NOT LIKE '%@postkorb.example'",
        "dq_reserved_rows": "SELECT 'never' AS rule, 0::BIGINT AS n UNION ALL SELECT 'no_taxonomy', count(*) FROM sk WHERE taxonomy_id IS NULL",
        "dedup_exact": "SELECT doc_id, content_hash, CAST(row_number() OVER (PARTITION BY content_hash ORDER BY doc_id) AS INT) AS copy_no FROM (SELECT DISTINCT doc_id, sha256(text) AS content_hash FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)",
        "eval_prf": _EVAL.format(g="role_id", c="role_id,"),
        "eval_prf_overall": _EVAL.replace("SELECT role_id, sum", "SELECT sum").format(g="ALL", c=""),
        "parse_month_date": """SELECT DISTINCT unnest([strftime(o_orderdate, '%b %Y'), strftime(o_orderdate, '%Y'), 'Xyz ' || strftime(o_orderdate, '%Y'), o_orderpriority]) AS text,
unnest([CAST(date_trunc('month', o_orderdate) AS DATE), CAST(date_trunc('year', o_orderdate) AS DATE), CAST(date_trunc('year', o_orderdate) AS DATE), NULL]) AS day FROM orders""",
        "label_load": "SELECT target_role_id, count(DISTINCT resume_id) AS n FROM synthetic_resume WHERE coalesce(source, '') IN ('', 'synthetic_generator') GROUP BY 1",
        "link_candidate_skills": f"SELECT * FROM cs UNION SELECT * FROM {_LABELPAIR}",
        "replace_children": f"SELECT * FROM cs WHERE candidate_id NOT IN (SELECT candidate_id FROM {_LABELPAIR}) UNION ALL SELECT * FROM {_LABELPAIR}",
        "manifest_upsert": """SELECT coalesce(a.batch, r.batch) AS batch, coalesce(a.n, -r.n) AS n FROM (SELECT lower(file_format) AS batch, count(*) AS n FROM raw_jd WHERE file_format IS NOT NULL GROUP BY 1) a
FULL JOIN (SELECT lower(file_format) AS batch, count(*) AS n FROM resume_document WHERE file_format IS NOT NULL GROUP BY 1) r ON a.batch = r.batch""",
        "link_unknown_skills": "SELECT canonical_id, count(*) FILTER (sk.id IS NULL) AS unknown, count(*) FILTER (sk.id IS NOT NULL) AS linked FROM (SELECT unnest(skills) AS canonical_id FROM lab) LEFT JOIN sk USING (canonical_id) GROUP BY 1",
        "replace_job_skills": "SELECT * FROM jskills WHERE job_id >= 'p' UNION ALL SELECT * FROM jskills WHERE is_required = 1 AND job_id NOT IN (SELECT job_id FROM jskills WHERE job_id >= 'p')",
        "write_defaults": "SELECT id, " + ", ".join(f"coalesce(nullif(trim({c}, ' '), ''), {v}) AS {c}" for c, v in (("full_name", "'Unknown'"), ("seniority_band", "'fresher'"), ("source", "'synthetic'"), ("location", "NULL"), ("phone", "NULL"))) + " FROM cand",
        "parse_outcome": "SELECT doc_id, CASE WHEN raw_text IS NULL THEN 'no text' WHEN NOT regexp_matches(raw_text, '\\S') THEN 'empty text' END AS error, CASE WHEN regexp_matches(coalesce(raw_text, ''), '\\S') THEN 'parsed' ELSE 'failed' END AS outcome, count(*) AS n_rows FROM resume_document GROUP BY 1, 2, 3",
        "label_emails": "SELECT resume_id, resume_id || '@synthetic.local' AS email FROM lab",
        "lookup_candidates": "SELECT asked, id FROM (SELECT DISTINCT lower(email) AS asked FROM candidates WHERE email IS NOT NULL) LEFT JOIN (SELECT lower(email) AS asked, min(id) AS id FROM cand GROUP BY 1) USING (asked)",
        "upsert_candidates": f"""SELECT coalesce(n.email, o.email) AS email, coalesce(o.id, n.id) AS id, CASE WHEN n.email IS NULL THEN o.full_name ELSE n.full_name END AS full_name, CASE WHEN o.email IS NULL THEN n.location ELSE o.location END AS location,
CASE WHEN n.email IS NULL THEN o.target_role_id ELSE n.target_role_id END AS target_role_id, CASE WHEN o.email IS NULL THEN n.seniority_band ELSE o.seniority_band END AS seniority_band
FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY email ORDER BY id) AS rn FROM cand WHERE email IS NOT NULL AND created_at < TIMESTAMP '2023-01-01') WHERE rn = 1) o
FULL JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY email ORDER BY {', '.join(c + ' NULLS LAST' for c in ('id', 'full_name', 'target_role_id', 'location', 'seniority_band'))}) AS rn FROM candidates WHERE email IS NOT NULL AND updated_at >= TIMESTAMP '2023-01-01') WHERE rn = 1) n ON o.email = n.email""",
        "evidence_upgrade": """SELECT candidate_id, skill_id, CASE WHEN up THEN n.evidence ELSE o.evidence END AS evidence, CASE WHEN up THEN n.source_section ELSE o.source_section END AS source_section
FROM (SELECT candidate_id, skill_id, o, n, n IS NOT NULL AND (o IS NULL OR (n.evidence = 'explicit' AND o.evidence <> 'explicit')) AS up FROM ev_old FULL JOIN ev_new USING (candidate_id, skill_id))""",
        "synthetic_sample": _sample_sql(60, 31),
        "synthetic_jd_sample": _sample_sql(70, 26),
        "match_tfidf": """SELECT resume_id, round(max(cosine), 6) AS best_cosine, count(*) AS n_jobs FROM (
  SELECT l.id AS resume_id, r.id, round(sum(l.w * l.w) / (any_value(ln.n) * any_value(rn.n)), 6) AS cosine FROM lw l JOIN rw r ON l.role_id = r.role_id AND l.term = r.term
  JOIN (SELECT id, sqrt(sum(w * w)) AS n FROM lw GROUP BY 1) ln ON ln.id = l.id JOIN (SELECT id, sqrt(sum(w * w)) AS n FROM rw GROUP BY 1) rn ON rn.id = r.id GROUP BY 1, 2) GROUP BY 1""",
        "insert_ignore_resumes": "SELECT sha256(doc_id) AS content_hash, doc_id, min(source_path) AS source_path FROM resume_document WHERE raw_text IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1, 2",
        "status_flip": "SELECT doc_id, CASE WHEN max(CASE WHEN regexp_matches(coalesce(raw_text, ''), '\\S') THEN 1 ELSE 0 END) = 1 THEN 'parsed' ELSE 'failed' END AS parsed_status FROM resume_document GROUP BY 1",
        "upsert_jobs": "SELECT sha256(job_id) AS content_hash, job_id, job_title, CASE WHEN job_id < 'p' THEN 'Unknown' ELSE company END AS company, role_id FROM job",
    }
    return {k: m.MODEL_SQL + (", " + v if k.startswith("eval_prf") else f", {_MORE[k]}\n{v}" if k in _MORE else v) for k, v in q.items()} | text_sql.with_steps(m.MODEL_SQL)
