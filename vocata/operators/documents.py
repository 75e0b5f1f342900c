"""Documents as rows of lines: segmentation, skill matching, entries, whole parses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import extract as x
from ..functions.text import block_kind, lines
from ..session import small

# Canonical sections of resumes in their order, heading labels, heading labels of adverts.
SECTIONS = ("summary", "skills", "experience", "projects", "education", "certifications")
SECTION_LABELS = (
    "summary", "objective", "profile", "about", "skills", "technical skills", "core competencies", "experience", "work experience", "professional experience",
    "employment", "work history", "projects", "personal projects", "key projects", "education", "academic", "education & training", "certifications", "certificates",
    "licenses", "awards", "achievements", "publications",
)
JD_LABELS = {
    "about the role": "about", "about us": "about", "summary": "about", "overview": "about", "responsibilities": "responsibilities", "what you'll do": "responsibilities",
    "the role": "responsibilities", "requirements": "requirements", "qualifications": "requirements", "what you'll need": "requirements", "preferred qualifications": "preferred",
    "nice to have": "preferred", "bonus": "preferred", "bonus points": "preferred",
}
BULLET_VERBS = r"^(Built|Developed|Analyzed|Automated|Designed|Optimized|Delivered)\b"


def document_lines(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``(doc_id, pos, text, kind)``: the lines that are not blank, once per distinct document row."""
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_t")).dropna().distinct()
    out = rows.select("doc_id", F.posexplode(lines(F.col("_t"))).alias("pos", "text")).filter(x.strip(F.col("text")) != "")
    return out.withColumn("kind", block_kind(F.col("text"), F.lit(None).cast("string")))


def _named(norm: Column) -> Column:
    """Section that a normalised heading names, else null; a label of the list decides before any part of one."""
    listed, part = {}, F.lit(None).cast("string")
    for label in SECTION_LABELS:
        for c in SECTIONS:
            if c in label or label in c:
                listed[label] = c
                break
    for c in reversed(SECTIONS):
        part = F.when(norm.contains(c), c).otherwise(part)
    known = F.create_map(*[F.lit(v) for kv in listed.items() for v in kv])
    return F.when(norm == "", None).when(norm.isin(*SECTION_LABELS), F.try_element_at(known, norm)).otherwise(part)


def _sections(rows: DataFrame, norm: Column, mark: Column, headings: bool) -> DataFrame:
    """Carries the mark of the last heading over the lines after it and drops the headings,
    or keeps them with an empty section.

    The normalised text is a column of its own, so its patterns run once a line.
    """
    w = W.partitionBy("doc_id").orderBy("pos")
    marked = rows.withColumn("_norm", norm).withColumn("_m", mark)
    marked = marked.withColumn("section", F.when(F.col("_m").isNotNull(), "").otherwise(F.coalesce(F.last("_m", ignorenulls=True).over(w), F.lit("header"))))
    return (marked if headings else marked.filter("_m IS NULL")).drop("_m", "_norm")


def segment(rows: DataFrame, headings: bool = False) -> DataFrame:
    """Adds ``section`` to resume lines and drops the headings; lines before any are ``header``."""
    norm = x.strip(F.regexp_replace(F.lower("text"), r"(?U)\s*\.*:*\s*$", ""))
    named = _named(F.col("_norm"))
    mark = F.coalesce(named, F.when(F.col("kind") == "heading", F.concat(F.lit("other::"), F.lower(x.strip(F.col("text"))))))
    return _sections(rows, norm, mark, headings)


def segment_jd(rows: DataFrame, headings: bool = False) -> DataFrame:
    """Adds ``section`` to advert lines by the exact heading labels and drops the headings."""
    norm = F.lower(x.strip(F.regexp_replace(F.col("text"), r"(?U)\s*:*\s*$", "")))
    known = F.create_map(*[F.lit(v) for kv in JD_LABELS.items() for v in kv])
    return _sections(rows, norm, F.try_element_at(known, F.col("_norm")), headings)


def skill_index(skills: DataFrame, aliases: DataFrame) -> DataFrame:
    """``(canonical_id, skill_id, name, surface, is_alias, prio)`` of active skills, longest surface first, aliases before names."""
    active = skills.filter("coalesce(is_active, false)").select(F.col("id").alias("skill_id"), "canonical_id", F.col("canonical_name").alias("name"))
    names = active.select("*", F.col("name").alias("surface"), F.lit(0).alias("is_alias"))
    more = aliases.select("skill_id", F.col("alias_text").alias("surface")).join(active, "skill_id").select("skill_id", "canonical_id", "name", "surface", F.lit(1).alias("is_alias"))
    every = names.unionByName(more).filter(x.strip(F.col("surface")) != "").distinct()
    w = W.partitionBy("canonical_id").orderBy(F.desc(F.length("surface")), F.desc("is_alias"), "surface")
    return every.withColumn("prio", F.row_number().over(w))


def match_skills(rows: DataFrame, index: DataFrame) -> DataFrame:
    """Skill hits ``(doc_id, section, pos, canonical_id, skill_id, name, surface_form, evidence)``, one per line and skill.

    A surface matches where no ASCII letter or digit stands right before or after it, in any
    case. Its first run of letters and digits must then be a whole run of the line, so lines
    meet surfaces in an equi-join on that run, and the pattern is tried on these pairs alone.
    """
    anchor = F.lower(F.regexp_extract("surface", r"[A-Za-z0-9]+", 0))  # a surface without one is tried on every line
    quoted = F.concat(F.lit(r"(?iu)(?<![A-Za-z0-9])\Q"), F.col("surface"), F.lit(r"\E(?![A-Za-z0-9])"))
    idx = index.withColumn("anchor", anchor).withColumn("pattern", quoted)
    found = F.regexp_extract_all(F.lower("text"), F.lit(r"([a-z0-9]+)"), F.lit(1))
    runs = rows.select("doc_id", "section", "pos", "text", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), found))).alias("anchor"))
    hits = runs.join(small(idx), "anchor").withColumn("surface_form", F.expr("regexp_substr(text, pattern)")).filter("surface_form IS NOT NULL")
    best = hits.groupBy("doc_id", "section", "pos", "canonical_id").agg(F.min_by(F.struct("skill_id", "name", "surface_form"), "prio").alias("h"))
    return best.select("doc_id", "section", "pos", "canonical_id", "h.*", F.when(F.col("section") == "skills", "explicit").otherwise("inferred").alias("evidence"))


def resume_skills(hits: DataFrame) -> DataFrame:
    """One row per resume and skill from skills, experience and projects, the first in that order."""
    rank = F.array_position(F.array(F.lit("skills"), F.lit("experience"), F.lit("projects")), F.col("section"))
    best = hits.withColumn("_r", rank).filter("_r > 0").groupBy("doc_id", "canonical_id").agg(F.min_by(F.struct("skill_id", "section", "surface_form", "evidence"), F.struct("_r", "pos")).alias("h"))
    return best.select("doc_id", "canonical_id", "h.*")


def jd_skills(hits: DataFrame) -> DataFrame:
    """One row per advert and skill: required if in responsibilities or requirements, else preferred."""
    kept = hits.filter(F.col("section").isin("responsibilities", "requirements", "preferred"))
    return kept.groupBy("doc_id", "canonical_id").agg(F.min("skill_id").alias("skill_id"), F.max(F.when(F.col("section") == "preferred", 0).otherwise(1)).alias("is_required"))


def education_entries(sections: DataFrame) -> DataFrame:
    rows = sections.filter("section = 'education'").withColumn("e", x.education(F.col("text"))).filter("e IS NOT NULL")
    return rows.select("doc_id", "pos", "e.*")


def _experience_lines(sections: DataFrame) -> DataFrame:
    """Lines of the experience section, whether each ``starts`` an entry, and the ``titled`` text it then has."""
    r = sections.filter("section = 'experience'").withColumn("t", x.strip(F.col("text"))).filter("t != ''")
    title_only = F.regexp_replace(F.regexp_replace(F.col("t"), x.DATE_RANGE, ""), r"^[ (\-):—]+|[ (\-):—]+$", "")
    bullet = (F.col("kind") == "bullet") | F.col("t").rlike(BULLET_VERBS)
    r = r.withColumns({"d": x.dates(F.col("t")), "title_only": title_only, "bullet": bullet})
    starts = ~F.col("bullet") & ((F.col("d").isNotNull() & (F.col("title_only") != "")) | (F.col("d").isNull() & F.col("kind").isin("subheading", "heading")))
    return r.withColumns({"starts": starts, "titled": F.when(F.col("d").isNotNull(), F.col("title_only")).otherwise(F.col("t"))})


def title_lines(sections: DataFrame) -> DataFrame:
    """``(doc_id, pos, text)``: the text of title and company of each line that begins an experience entry."""
    return _experience_lines(sections).filter("starts").select("doc_id", "pos", F.col("titled").alias("text"))


def experience_entries(sections: DataFrame) -> DataFrame:
    """Entries of the experience section: a dated line with a title, or an undated subheading,
    begins one; other lines are its bullets. Lines before the first entry belong to none."""
    w = W.partitionBy("doc_id").orderBy("pos")
    r = _experience_lines(sections).withColumn("entry", F.sum(F.col("starts").cast("int")).over(w)).filter("entry > 0")
    head = F.when(F.col("starts"), F.struct(x.title_company(F.col("titled")).alias("tc"), F.col("d").alias("d")))
    late = F.when(~F.col("starts") & ~F.col("bullet") & (F.col("title_only") == ""), F.col("d"))
    body = F.when(~F.col("starts") & (F.col("bullet") | F.col("d").isNull()), F.struct("pos", "t"))
    g = r.withColumns({"head": head, "late": late, "body": body}).groupBy("doc_id", "entry").agg(
        F.first("head", ignorenulls=True).alias("h"), F.min_by("late", F.when(F.col("late").isNotNull(), F.col("pos"))).alias("late"), F.array_sort(F.collect_list("body")).alias("b")
    )  # the lines of one entry of one document
    when = F.coalesce("h.d", "late")
    return g.select("doc_id", "entry", "h.tc.title", "h.tc.company", when["start"].alias("start"), when["end"].alias("end"), F.coalesce(when["is_current"], F.lit(False)).alias("is_current"), F.col("b.t").alias("bullets"))


def project_entries(sections: DataFrame) -> DataFrame:
    """A subheading or ``project:`` line begins one; its description is its last other line; text before any opens a nameless one."""
    r = sections.filter("section = 'projects'").withColumn("t", x.strip(F.col("text"))).filter("t != ''")
    starts = (F.col("kind") == "subheading") | F.startswith(F.lower("t"), F.lit("project:"))
    w = W.partitionBy("doc_id").orderBy("pos")
    r = r.withColumn("starts", starts).withColumn("entry", F.sum(F.col("starts").cast("int")).over(w))
    return r.groupBy("doc_id", "entry").agg(F.coalesce(F.max(F.when(F.col("starts"), F.col("t"))), F.lit("")).alias("name"), F.coalesce(F.max_by(F.when(~F.col("starts"), F.col("t")), F.when(~F.col("starts"), F.col("pos"))), F.lit("")).alias("description"))


def project_skills(sections: DataFrame, index: DataFrame) -> DataFrame:
    """``(doc_id, entry, name, tech_stack)``: the skills in the last line of each project's text, as a JSON array."""
    w = W.partitionBy("doc_id").orderBy("pos")
    r = sections.filter("section = 'projects'").withColumn("t", x.strip(F.col("text"))).filter("t != ''")
    r = r.withColumn("starts", (F.col("kind") == "subheading") | F.startswith(F.lower("t"), F.lit("project:"))).withColumn("entry", F.sum(F.col("starts").cast("int")).over(w))
    last = r.groupBy("doc_id", "entry").agg(F.coalesce(F.max(F.when(F.col("starts"), F.col("t"))), F.lit("")).alias("name"), F.max(F.when(~F.col("starts"), F.col("pos"))).alias("pos"))
    hits = match_skills(sections.filter("section = 'projects'"), index).groupBy("doc_id", "pos").agg(F.array_sort(F.collect_set("canonical_id")).alias("found"))
    none = F.array().cast("array<string>")
    return last.join(hits, ["doc_id", "pos"], "left").select("doc_id", "entry", "name", F.to_json(F.coalesce("found", none)).alias("tech_stack"))


def parse_outcome(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``(doc_id, error, outcome, n_rows)``: rows that can be parsed, and those that fail with the reason."""
    t = F.col(text)
    error = F.when(t.isNull(), "no text").when(~t.rlike(r"\S"), "empty text")
    rows = docs.select(F.col(doc_id).alias("doc_id"), error.alias("error"))
    return rows.groupBy("doc_id", "error", F.when(F.col("error").isNull(), "parsed").otherwise("failed").alias("outcome")).agg(F.count("*").alias("n_rows"))


def certificate_entries(sections: DataFrame) -> DataFrame:
    rows = sections.filter("section = 'certifications'").withColumn("c", x.certificate(F.col("text")))
    return rows.select("doc_id", "pos", "c.*")


def jd_header(sections: DataFrame) -> DataFrame:
    """``(doc_id, job_title, company, location)`` from the first two header lines."""
    h = sections.filter("section = 'header'").withColumn("n", F.row_number().over(W.partitionBy("doc_id").orderBy("pos"))).filter("n <= 2")
    h = h.groupBy("doc_id").agg(F.max(F.when(F.col("n") == 1, x.strip(F.col("text")))).alias("job_title"), F.max(F.when(F.col("n") == 2, F.col("text"))).alias("second"))
    second = F.coalesce("second", F.lit(""))
    return h.select("doc_id", "job_title", x.strip(F.substring_index(second, "|", 1)).alias("company"), F.when(second.contains("|"), x.strip(F.substring_index(second, "|", -1))).otherwise("").alias("location"))


def parse_jd(rows: DataFrame, index: DataFrame) -> DataFrame:
    """One row per advert: header, years, seniority, role, required and preferred skills, and its lines of each kind.

    The text is read twice: for the lines of each advert in one aggregate, and for the skills.
    """
    s = segment_jd(rows, headings=True)  # a document of headings alone is a row, too
    sec, line = F.col("section"), F.struct("pos", x.bullet_text(F.col("text")).alias("t"))
    of = lambda name: F.array_sort(F.collect_list(F.when(sec == name, line)))["t"].alias(name)
    header = F.array_sort(F.collect_list(F.when(sec == "header", F.struct("pos", "text"))))["text"]
    lines = s.groupBy("doc_id").agg(header.alias("h"), F.min(F.when(sec == "requirements", x.years(F.col("text")))).alias("years_min"), of("responsibilities"), of("requirements"))
    first, second = F.try_element_at("h", F.lit(1)), F.coalesce(F.try_element_at("h", F.lit(2)), F.lit(""))
    any_header = F.size("h") > 0
    lines = lines.select(
        "doc_id", "years_min", "responsibilities", "requirements", x.strip(first).alias("job_title"), F.when(any_header, x.strip(F.substring_index(second, "|", 1))).alias("company"),
        F.when(any_header, F.when(second.contains("|"), x.strip(F.substring_index(second, "|", -1))).otherwise("")).alias("location"),
    )
    found = jd_skills(match_skills(s.filter(sec.isin("responsibilities", "requirements", "preferred")), index))
    found = found.groupBy("doc_id").agg(*[F.array_sort(F.collect_set(F.when(F.col("is_required") == k, F.col("canonical_id")))).alias(n) for k, n in ((1, "required"), (0, "preferred"))])
    none = F.array().cast("array<string>")
    return lines.join(found, "doc_id", "left").select(
        "doc_id", "job_title", "company", "location", "years_min", x.seniority(F.col("job_title"), F.col("years_min")).alias("seniority"), x.role(F.col("job_title")).alias("role_id"),
        F.coalesce("required", none).alias("required"), F.coalesce("preferred", none).alias("preferred"), "responsibilities", "requirements",
    )


def parse_resume(rows: DataFrame, index: DataFrame) -> DataFrame:
    """One row per resume: contact fields, entries of each kind, skills with their evidence.

    The text is read twice: for the lines, whose windows and aggregates all go by document
    and so need one shuffle, and for the skills.
    """
    s = segment(rows, headings=True)  # a document of headings alone is a row, too
    sec, t = F.col("section"), x.strip(F.col("text"))
    title_only = F.regexp_replace(F.regexp_replace(F.col("t"), x.DATE_RANGE, ""), r"^[ (\-):—]+|[ (\-):—]+$", "")
    r = s.withColumn("t", t).withColumns({"d": F.when(sec == "experience", x.dates(F.col("t"))), "title_only": F.when(sec == "experience", title_only)})
    bullet = (F.col("kind") == "bullet") | F.col("t").rlike(BULLET_VERBS)
    begins = F.when(sec == "experience", ~bullet & ((F.col("d").isNotNull() & (F.col("title_only") != "")) | (F.col("d").isNull() & F.col("kind").isin("subheading", "heading"))))
    begins = begins.when(sec == "projects", (F.col("kind") == "subheading") | F.startswith(F.lower("t"), F.lit("project:"))).otherwise(False)
    r = r.withColumns({"starts": begins, "bullet": bullet})
    both = F.sum(F.col("starts").cast("int")).over(W.partitionBy("doc_id", "section").orderBy("pos"))
    # an entry is a run of lines of experience or projects; other lines stand for themselves
    r = r.withColumn("entry", F.when(sec.isin("experience", "projects"), both).otherwise(F.col("pos")))
    head = F.struct(x.title_company(F.when(F.col("d").isNotNull(), F.col("title_only")).otherwise(F.col("t"))).alias("tc"), F.col("d").alias("d"))
    starts, late = F.col("starts"), ~F.col("starts") & ~F.col("bullet") & (F.col("title_only") == "") & F.col("d").isNotNull()
    body = ~starts & F.when(sec == "experience", F.col("bullet") | F.col("d").isNull()).otherwise(True)
    parts = r.groupBy("doc_id", "section", "entry").agg(
        F.min("pos").alias("pos"), F.first(F.when(starts, head), ignorenulls=True).alias("h"), F.min_by(F.when(late, F.col("d")), F.when(late, F.col("pos"))).alias("late"),
        F.max(F.when(starts, F.col("t"))).alias("named"), F.array_sort(F.collect_list(F.when(body, F.struct("pos", "t"))))["t"].alias("lines"), F.first("text").alias("text"),
    )
    when = F.coalesce("h.d", "late")
    experience = F.when((sec == "experience") & (F.col("entry") > 0), F.struct("entry", "h.tc.title", "h.tc.company", when["start"].alias("start"), when["end"].alias("end"), F.coalesce(when["is_current"], F.lit(False)).alias("is_current"), F.col("lines").alias("bullets")))
    project = F.when(sec == "projects", F.struct("entry", F.coalesce("named", F.lit("")).alias("name"), F.coalesce(F.try_element_at("lines", F.lit(-1)), F.lit("")).alias("description")))
    e, c = x.education(F.col("text")), x.certificate(F.col("text"))
    education = F.when((sec == "education") & e.isNotNull(), F.struct("pos", e["degree"].alias("degree"), e["field_of_study"].alias("field_of_study"), e["institution"].alias("institution"), e["year"].alias("year")))
    certificate = F.when(sec == "certifications", F.struct("pos", c["name"].alias("name"), c["issuer"].alias("issuer")))
    every = lambda v: F.array_sort(F.collect_list(v))
    out = parts.groupBy("doc_id").agg(
        every(F.when(sec == "header", F.struct("pos", "text")))["text"].alias("h"), every(education).alias("education"), every(experience).alias("experience"), every(project).alias("projects"), every(certificate).alias("certifications")
    )
    has, text = F.size("h") > 0, F.array_join("h", "\n")
    field = lambda v: F.when(has, v)
    found = resume_skills(match_skills(s.filter(sec.isin("skills", "experience", "projects")), index))
    found = found.groupBy("doc_id").agg(F.array_sort(F.collect_set("canonical_id")).alias("skills"), F.count_if(F.col("evidence") == "explicit").alias("n_explicit"))
    kinds = ("education", "experience", "projects", "certifications")
    return out.join(found, "doc_id", "left").select(
        "doc_id", field(x.name(F.try_element_at("h", F.lit(1)))).alias("name"), field(x.email(text)).alias("email"), field(x.phone(text)).alias("phone"), field(x.location(text)).alias("location"),
        F.coalesce("skills", F.array().cast("array<string>")).alias("skills"), F.coalesce("n_explicit", F.lit(0)).alias("n_explicit"), *[F.size(k).cast("long").alias(f"n_{k}") for k in kinds], *kinds,
    )
