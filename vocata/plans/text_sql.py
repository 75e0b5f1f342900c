"""SQL of the document queries: cleaning, segmentation, skill matching, fields and parses.

Windows over the lines of a document, written for an engine without look-around, with
Unicode classes spelt out; each table expression builds on those before it.
"""

from __future__ import annotations

from ..functions import extract as x
from ..functions import text as t
from ..operators import documents as d

_WS = r"[\s\p{Z}\x0b\x1c-\x1f\x{85}]"
_W = r"[\p{L}\p{M}\p{N}\p{Pc}]"
_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{_WS}+|{_WS}+$', '', 'g')"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _lines(table: str, key: str) -> str:
    return rf"""SELECT doc_id, CAST(pos AS INT) AS pos, text, {_strip('text')} AS t, CASE WHEN starts_with(lower(ltrim(text)), 'project:') THEN 'subheading' ELSE 'normal' END AS kind
FROM (SELECT doc_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS text FROM (SELECT {key} AS doc_id, string_split_regex(raw_text, '{_BREAK}') AS l FROM (SELECT DISTINCT {key}, raw_text FROM {table} WHERE raw_text <> '' AND {key} IS NOT NULL))) WHERE regexp_matches(text, '[^\s\p{{Z}}\x0b\x1c-\x1f\x{{85}}]')"""


def _carried(lines: str, norm: str, mark: str) -> str:
    return f"""SELECT * EXCLUDE (mark, carried), coalesce(carried, 'header') AS section FROM (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS carried
FROM (SELECT *, {mark} AS mark FROM (SELECT *, {norm} AS norm FROM {lines}))) WHERE mark IS NULL"""


_NAMED = (
    "CASE WHEN norm = '' THEN NULL WHEN norm IN (" + ", ".join(map(_quoted, d.SECTION_LABELS)) + ") THEN (CASE "
    + " ".join(f"WHEN contains(norm, '{c}') OR contains('{c}', norm) THEN '{c}'" for c in d.SECTIONS)
    + " END) ELSE (CASE " + " ".join(f"WHEN contains(norm, '{c}') THEN '{c}'" for c in d.SECTIONS) + " END) END"
)
_JD_MARK = "CASE norm " + " ".join(f"WHEN {_quoted(k)} THEN '{v}'" for k, v in d.JD_LABELS.items()) + " END"


def _dates(c: str) -> str:
    return f"regexp_extract({c}, {_quoted(x.DATE_RANGE)}, ['start', 'stop'])"


def _meet(lines: str) -> str:
    return f"SELECT l.doc_id, l.section, l.pos, l.text, i.* FROM {lines} l JOIN idx i ON contains(lower(text), lower(surface))"


def _hits(pairs: str) -> str:
    return rf"""SELECT doc_id, section, pos, canonical_id, min_by(skill_id, prio) AS skill_id, min_by(name, prio) AS name, min_by(form, prio) AS surface_form, CASE WHEN section = 'skills' THEN 'explicit' ELSE 'inferred' END AS evidence
FROM (SELECT *, regexp_extract(text, '(?i)(?:^|[^A-Za-z0-9])(' || regexp_escape(surface) || ')(?:$|[^A-Za-z0-9])', 1) AS form FROM {pairs}) WHERE form <> '' GROUP BY doc_id, section, pos, canonical_id"""


_DEGREE = [f"nullif({_strip(f'regexp_extract(t, {_quoted(x.DEGREE)}, {i})')}, '')" for i in range(5)]
_FIRST_SEP = f"(SELECT {{out}} FROM (SELECT unnest([{', '.join(map(_quoted, x.SEPARATORS))}]) AS sep, generate_subscripts([{', '.join(map(_quoted, x.SEPARATORS))}], 1) AS i) WHERE contains({{c}}, sep) ORDER BY i LIMIT 1)"


def _title(c: str) -> str:
    return f"coalesce({_FIRST_SEP.format(out=_strip(f'split_part({c}, sep, 1)'), c=c)}, {_strip(c)})"


def _company(c: str) -> str:
    return f"coalesce({_FIRST_SEP.format(out=_strip(f'substr({c}, instr({c}, sep) + length(sep))'), c=c)}, '')"


def _years(c: str) -> str:
    rest = f"regexp_replace({c}, {_quoted(x.YEARS_RANGE)}, ' ', 'g')"
    return f"list_min(list_transform(list_concat(regexp_extract_all({c}, {_quoted(x.YEARS_RANGE)}, 1), regexp_extract_all({rest}, {_quoted(x.YEARS)}, 1)), lambda v: CAST(v AS INT)))"


_SENIORITY = """CASE WHEN regexp_matches(lower(coalesce(job_title, '')), 'junior|entry|graduate') THEN 'fresher' WHEN regexp_matches(lower(coalesce(job_title, '')), 'senior|lead|staff|principal') THEN 'senior'
WHEN years_min <= 1 THEN 'fresher' WHEN years_min >= 5 THEN 'senior' ELSE 'mid' END"""
_ROLE = "CASE " + " ".join(f"WHEN contains(lower(job_title), {_quoted(k)}) THEN '{v}'" for k, v in x.ROLE_HINTS.items()) + f" ELSE '{x.DEFAULT_ROLE}' END"
_PHONE = r"\+?\d[\d\s().-]{7,}\d"

#: Table expressions after those of the operational model, in the order in which they build on each other.
STEPS = {
    "rl": _lines("resume_document", "doc_id"),
    "jl": _lines("raw_jd", "jd_id"),
    "rs": _carried("rl", _strip(rf"regexp_replace(lower(text), '{_WS}*\.*:*{_WS}*$', '')"), _NAMED),
    "js": _carried("jl", f"lower({_strip(f"regexp_replace(text, '{_WS}*:*{_WS}*$', '')")})", _JD_MARK),
    "ali": "SELECT alias_text, skill_id FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(alias_text, ' ')) ORDER BY id NULLS LAST, skill_id) AS rn FROM skill_alias WHERE skill_id IS NOT NULL AND alias_text IS NOT NULL) WHERE rn = 1",
    "idx": f"""SELECT *, CAST(row_number() OVER (PARTITION BY canonical_id ORDER BY length(surface) DESC, is_alias DESC, surface) AS INT) AS prio FROM (
SELECT DISTINCT * FROM (SELECT id AS skill_id, canonical_id, canonical_name AS name, canonical_name AS surface, 0 AS is_alias FROM sk WHERE is_active UNION ALL SELECT sk.id, sk.canonical_id, sk.canonical_name, alias_text, 1 FROM ali JOIN sk ON sk.id = ali.skill_id WHERE is_active) WHERE {_strip('surface')} <> '')""",
    "jmeet": _meet("(SELECT * FROM js WHERE section IN ('responsibilities', 'requirements', 'preferred'))"),
    "rmeet": _meet("(SELECT * FROM rs WHERE section IN ('skills', 'experience', 'projects'))"),
    "jhit": _hits("jmeet"),
    "rhit": _hits("rmeet"),
    "jskill": "SELECT doc_id, canonical_id, min(skill_id) AS skill_id, max(CASE WHEN section = 'preferred' THEN 0 ELSE 1 END) AS is_required FROM jhit GROUP BY 1, 2",
    "rskill": "SELECT doc_id, canonical_id, skill_id, section, surface_form, evidence FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, canonical_id ORDER BY list_position(['skills', 'experience', 'projects'], section), pos) AS rn FROM rhit) WHERE rn = 1",
    "edu": f"""SELECT doc_id, pos, CASE WHEN hit THEN {_DEGREE[1]} ELSE t END AS degree, CASE WHEN hit THEN {_DEGREE[2]} END AS field_of_study, CASE WHEN hit THEN {_DEGREE[3]} END AS institution, CASE WHEN hit THEN CAST({_DEGREE[4]} AS INT) END AS year
FROM (SELECT *, regexp_matches(t, {_quoted(x.DEGREE)}) AS hit FROM rs WHERE section = 'education') WHERE hit OR ({" OR ".join(f"contains(lower(t), {_quoted(w.lower())})" for w in x.DEGREE_TOKENS)})""",
    "exl": f"""SELECT *, NOT bullet AND ((dated AND title_only <> '') OR (NOT dated AND kind IN ('subheading', 'heading'))) AS starts, CASE WHEN dated THEN title_only ELSE t END AS titled FROM (
SELECT *, regexp_matches(t, {_quoted(x.DATE_RANGE)}) AS dated, {_dates('t')} AS d, regexp_replace(regexp_replace(t, {_quoted(x.DATE_RANGE)}, '', 'g'), '^[ (\\-):—]+|[ (\\-):—]+$', '', 'g') AS title_only, kind = 'bullet' OR regexp_matches(t, '{d.BULLET_VERBS}') AS bullet FROM rs WHERE section = 'experience')""",
    "exp": f"""SELECT doc_id, entry, max(CASE WHEN starts THEN {_title('titled')} END) AS title, max(CASE WHEN starts THEN {_company('titled')} END) AS company, max(CASE WHEN starts THEN dated END) AS has, max(CASE WHEN starts AND dated THEN d.start END) AS s1, max(CASE WHEN starts AND dated THEN d.stop END) AS e1,
min_by(d.start, pos) FILTER (NOT starts AND NOT bullet AND title_only = '' AND dated) AS s2, min_by(d.stop, pos) FILTER (NOT starts AND NOT bullet AND title_only = '' AND dated) AS e2, coalesce(list(t ORDER BY pos) FILTER (NOT starts AND (bullet OR NOT dated)), []) AS bullets
FROM (SELECT *, sum(CAST(starts AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) AS entry FROM exl) WHERE entry > 0 GROUP BY doc_id, entry""",
    "proj": """SELECT doc_id, entry, coalesce(max(CASE WHEN starts THEN t END), '') AS name, coalesce(max_by(t, pos) FILTER (NOT starts), '') AS description FROM (SELECT *, sum(CAST(starts AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) AS entry
FROM (SELECT *, kind = 'subheading' OR starts_with(lower(t), 'project:') AS starts FROM rs WHERE section = 'projects')) GROUP BY doc_id, entry""",
    "cert": f"SELECT doc_id, pos, CASE WHEN regexp_matches(t, '{x.CERT_CODE}') THEN {_strip(f"regexp_replace(t, '{x.CERT_CODE}', '', 'g')")} ELSE t END AS name, CASE {' '.join(f"WHEN starts_with(lower(t), '{i.lower()}') THEN '{i}'" for i in x.ISSUERS)} ELSE '' END AS issuer FROM rs WHERE section = 'certifications'",
    "jhead": f"""SELECT doc_id, max(CASE WHEN n = 1 THEN t END) AS job_title, {_strip("split_part(coalesce(max(CASE WHEN n = 2 THEN text END), ''), '|', 1)")} AS company, CASE WHEN contains(coalesce(max(CASE WHEN n = 2 THEN text END), ''), '|') THEN {_strip("split_part(max(CASE WHEN n = 2 THEN text END), '|', -1)")} ELSE '' END AS location
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM js WHERE section = 'header') WHERE n <= 2 GROUP BY doc_id""",
    "jyear": f"SELECT doc_id, min(CASE WHEN section = 'requirements' THEN {_years('text')} END) AS years_min FROM js GROUP BY 1",
    "rhead": f"""SELECT doc_id, CASE WHEN NOT regexp_matches(first, '[\\p{{Nd}}@|]') AND len(string_split_regex(first, '{_WS}+')) <= 4 THEN first END AS name, nullif(regexp_extract(whole, '[\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}.\\-+]+@[\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}.\\-]+\\.{_W}+'), '') AS email,
list_filter(list_transform(string_split_regex(whole, '{_BREAK}'), lambda v: regexp_extract(v, '{_PHONE}')), lambda v: v <> '')[1] AS phone, nullif({_strip(f"split_part(list_filter(string_split_regex(whole, '{_BREAK}'), lambda v: contains(v, '@') AND contains(v, '|'))[1], '|', -1)")}, '') AS location FROM {{src}}""",
}
_WHOLE = f"(SELECT doc_id, raw_text AS whole, {_strip(f"list_filter(string_split_regex(raw_text, '{_BREAK}'), lambda v: {_strip('v')} <> '')[1]")} AS first FROM (SELECT DISTINCT doc_id, raw_text FROM resume_document WHERE doc_id IS NOT NULL AND raw_text IS NOT NULL))"
_HEADER = "(SELECT doc_id, string_agg(text, chr(10) ORDER BY pos) AS whole, min_by(t, pos) AS first FROM rs WHERE section = 'header' GROUP BY 1)"
TEXTS = "(SELECT DISTINCT jd_id AS doc_id, raw_text FROM raw_jd WHERE raw_text IS NOT NULL UNION SELECT doc_id, raw_text FROM resume_document WHERE raw_text IS NOT NULL)"
_PUNCT = lambda c: f"translate({c}, '{t.PUNCTUATION[0]}', '{t.PUNCTUATION[1].replace(chr(39), chr(39) * 2)}')"
_HYPHEN = lambda c: rf"regexp_replace({c}, '({_W})-{_WS}*\n{_WS}*([a-z])', '\1\2', 'g')"
_SPACES = lambda c: rf"array_to_string(list_filter(list_transform(string_split_regex(regexp_replace({c}, '[ \t]+', ' ', 'g'), '{_BREAK}'), lambda v: {_strip('v')}), lambda v: v <> ''), chr(10))"
# compatibility forms that stripping accents leaves as they are
_FOLD = lambda c: "regexp_replace(strip_accents(" + "replace(" * 5 + c + ", 'º', 'o'), 'ª', 'a'), '…', '...'), chr(160), ' '), '’', '')" + r"), '[^\x00-\x7F]', '', 'g')"
_CLEAN = lambda c: _SPACES(f"regexp_replace({_HYPHEN(_PUNCT(c))}, '{t.BULLETS}', ' ', 'g')")
_HASHED = lambda f: f"SELECT doc_id, sha256({f('raw_text')}) AS out FROM {TEXTS}"
_ENTRY_COUNTS = "".join(f", coalesce({n}.n, 0) AS n_{c}" for n, c in (("edu", "education"), ("exp", "experience"), ("proj", "projects"), ("cert", "certifications")))
_ENTRY_JOINS = "".join(f" LEFT JOIN (SELECT doc_id, count(*) AS n FROM {n} GROUP BY 1) {n} USING (doc_id)" for n in ("edu", "exp", "proj", "cert"))
_PARSED = f"""SELECT * FROM (SELECT b.doc_id, h.name, h.email, h.phone, h.location, coalesce(s.skills, []) AS skills, coalesce(s.n_explicit, 0) AS n_explicit{_ENTRY_COUNTS} FROM (SELECT DISTINCT doc_id FROM rl) b LEFT JOIN ({STEPS['rhead'].replace('{src}', _HEADER)}) h USING (doc_id)
LEFT JOIN (SELECT doc_id, list(DISTINCT canonical_id ORDER BY canonical_id) AS skills, count(*) FILTER (evidence = 'explicit') AS n_explicit FROM rskill GROUP BY 1) s USING (doc_id){_ENTRY_JOINS})"""
_EXP_OUT = "SELECT doc_id, entry, title, company, CASE WHEN has THEN s1 ELSE s2 END AS start, CASE WHEN has THEN e1 ELSE e2 END AS \"end\", coalesce(lower(CASE WHEN has THEN e1 ELSE e2 END) IN ('present', 'current'), false) AS is_current, bullets FROM exp"
_MONTHS = ", ".join(f"'{m.lower()}'" for m in t.MONTHS)
_DAY = f"""CASE WHEN regexp_matches(text, '^[A-Za-z]{{3,9}}\\.?\\s+\\d{{4}}') THEN make_date(CAST(regexp_extract(text, '(\\d{{4}})', 1) AS INT), coalesce(CAST(list_position([{_MONTHS}], lower(substr(text, 1, 3))) AS INT), 1), 1) WHEN regexp_matches(text, '^\\d{{4}}') THEN make_date(CAST(substr(text, 1, 4) AS INT), 1, 1) END"""
_DATES = f"SELECT doc_id, pos, d.start AS start, d.stop AS \"end\", lower(d.stop) IN ('present', 'current') AS is_current FROM (SELECT doc_id, pos, {_dates('text')} AS d FROM rl WHERE regexp_matches(text, {_quoted(x.DATE_RANGE)}))"


def _scrub(kinds: list[str]) -> str:
    """The pattern of each kind on what the one before left, cut at its matches and joined with their stand-ins."""
    plain = {k: p.replace("(?U)", "") for k, p in t.SCRUB}
    digest = lambda n: f"substr(sha1(v), 1, {n})"
    instead = {
        "email": f"'user_' || {digest(6)} || '@example.com'", "ssn": "'redacted_ssn'", "credit_card": "'redacted_cc'", "url": f"'https://example.com/page_' || {digest(6)}", "phone": f"'+1-555-' || {digest(3)} || '-0000'",
    }
    q = f"SELECT doc_id, raw_text AS s FROM {TEXTS}"
    for k in kinds:
        q = f"""SELECT * EXCLUDE (s, m, r), CAST(len(m) AS INT) AS {k}, array_to_string(list_transform(list_zip(r, m), lambda z: coalesce(z[1], '') || coalesce(z[2], '')), '') AS s
FROM (SELECT * EXCLUDE (m), list_transform(m, lambda v: {instead[k]}) AS m FROM (SELECT *, regexp_extract_all(s, {_quoted(plain[k])}) AS m, string_split_regex(s, {_quoted(plain[k])}) AS r FROM ({q})))"""
    return q


def queries() -> dict[str, str]:
    """SQL by query name, to stand behind the table expressions of the model and :data:`STEPS`."""
    kinds = [k for k, _ in t.SCRUB]
    return {
        "ascii_fold": _HASHED(_FOLD), "dehyphenate": _HASHED(_HYPHEN), "collapse_ws": _HASHED(_SPACES), "clean_document": _HASHED(lambda c: _FOLD(_CLEAN(c))),
        "block_kind": "SELECT doc_id, kind, count(*) AS n FROM rl GROUP BY 1, 2",
        "scrub_pii": f"SELECT doc_id, s AS scrubbed FROM ({_scrub(kinds)})", "scrub_pii_counts": f"SELECT doc_id, {', '.join(kinds)} FROM ({_scrub(kinds)})",
        "segment_sections": "SELECT doc_id, section, count(*) AS n_lines FROM rs GROUP BY 1, 2", "segment_jd": "SELECT doc_id, section, count(*) AS n_lines FROM js GROUP BY 1, 2",
        "skill_index": "SELECT skill_id, canonical_id, name, surface, is_alias, prio FROM idx",
        "skill_match": "SELECT * FROM jhit", "jd_skills": "SELECT * FROM jskill", "resume_skills": "SELECT * FROM rskill",
        **{f"extract_{c}": f"SELECT doc_id, {c} FROM ({STEPS['rhead'].replace('{src}', _WHOLE)})" for c in ("email", "phone", "location", "name")},
        "extract_education": "SELECT * FROM edu", "extract_dates": _DATES, "extract_experience": _EXP_OUT, "extract_projects": "SELECT * FROM proj", "extract_certs": "SELECT * FROM cert",
        "split_title_company": f"SELECT doc_id, pos, {_title('titled')} AS title, {_company('titled')} AS company FROM exl WHERE starts",
        "resume_month_dates": f"SELECT doc_id, pos, edge, text, {_DAY} AS day FROM (SELECT doc_id, pos, unnest(['start', 'end']) AS edge, unnest([start, \"end\"]) AS text FROM ({_DATES}))",
        "jd_years": f"SELECT * FROM (SELECT doc_id, pos, {_years('text')} AS years FROM jl) WHERE years IS NOT NULL",
        "jd_seniority": f"SELECT doc_id, job_title, years_min, {_SENIORITY} AS seniority FROM jhead JOIN jyear USING (doc_id)",
        "jd_role": f"SELECT doc_id, {_ROLE} AS role_id, CASE WHEN contains(lower(job_title), 'revenue') THEN 'revenue_analyst' WHEN contains(lower(job_title), 'pipeline') THEN 'pipeline_engineer' WHEN contains(lower(job_title), 'model') THEN 'model_engineer' ELSE '{x.DEFAULT_ROLE}' END AS given_role_id FROM jhead",
        "jd_bullets": "SELECT doc_id, section, pos, ltrim(text, '- ') AS text FROM js WHERE section IN ('responsibilities', 'requirements')",
        "project_skills": """SELECT doc_id, entry, name, coalesce(to_json(list(canonical_id ORDER BY canonical_id) FILTER (canonical_id IS NOT NULL)), '[]')::VARCHAR AS tech_stack FROM (SELECT DISTINCT p.doc_id, p.entry, p.name, h.canonical_id FROM proj p
LEFT JOIN (SELECT doc_id, entry, max(pos) FILTER (NOT starts) AS pos FROM (SELECT *, sum(CAST(starts AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) AS entry FROM (SELECT *, kind = 'subheading' OR starts_with(lower(t), 'project:') AS starts FROM rs WHERE section = 'projects')) GROUP BY 1, 2) l ON l.doc_id = p.doc_id AND l.entry = p.entry
LEFT JOIN rhit h ON h.doc_id = p.doc_id AND h.pos = l.pos AND h.section = 'projects') GROUP BY 1, 2, 3""",
        "jd_header": "SELECT * FROM jhead", "jd_text_years": "SELECT * FROM jyear",
        "eval_parse": """SELECT role_id, role_id IS NULL AS overall, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r
FROM (SELECT role_id, CAST(sum(p * t) AS BIGINT) AS tp, CAST(sum(p * (1 - t)) AS BIGINT) AS fp, CAST(sum((1 - p) * t) AS BIGINT) AS fn FROM (SELECT doc_id, canonical_id, max(p) AS p, max(t) AS t FROM (SELECT doc_id, canonical_id, 1 AS p, 0 AS t FROM rskill UNION ALL SELECT resume_id, unnest(skills), 0, 1 FROM lab) GROUP BY 1, 2) b
JOIN (SELECT resume_id, role_id FROM lab WHERE resume_id IN (SELECT doc_id FROM resume_document)) q ON q.resume_id = b.doc_id GROUP BY ROLLUP (role_id)))""",
        "parse_resume": f"""SELECT p.*, coalesce(j.s, '') AS projects, coalesce(c.s, '') AS certifications FROM ({_PARSED}) p
LEFT JOIN (SELECT doc_id, string_agg('{{"entry":' || entry || ',"name":' || to_json(name) || ',"description":' || to_json(description) || '}}', chr(10) ORDER BY entry) AS s FROM proj GROUP BY 1) j USING (doc_id)
LEFT JOIN (SELECT doc_id, string_agg('{{"pos":' || pos || ',"name":' || to_json(name) || ',"issuer":' || to_json(issuer) || '}}', chr(10) ORDER BY pos) AS s FROM cert GROUP BY 1) c USING (doc_id)""",
        "parse_entries": "SELECT doc_id, 'education' AS kind, degree AS a, institution AS b, year::VARCHAR AS c, 0 AS n_bullets FROM edu UNION ALL SELECT doc_id, 'experience', title, company, CASE WHEN has THEN s1 ELSE s2 END, len(bullets)::INT FROM exp",
        "parse_jd": f"""SELECT doc_id, job_title, company, location, years_min, {_SENIORITY} AS seniority, {_ROLE} AS role_id, coalesce(required, []) AS required, coalesce(preferred, []) AS preferred, coalesce(responsibilities, '') AS responsibilities, coalesce(requirements, '') AS requirements FROM (SELECT DISTINCT doc_id FROM jl) LEFT JOIN (SELECT doc_id, string_agg(ltrim(text, '- '), chr(10) ORDER BY pos) FILTER (section = 'responsibilities') AS responsibilities,
string_agg(ltrim(text, '- '), chr(10) ORDER BY pos) FILTER (section = 'requirements') AS requirements FROM js GROUP BY 1) USING (doc_id) LEFT JOIN jhead USING (doc_id) LEFT JOIN jyear USING (doc_id)
LEFT JOIN (SELECT doc_id, list(canonical_id ORDER BY canonical_id) FILTER (is_required = 1) AS required, list(canonical_id ORDER BY canonical_id) FILTER (is_required = 0) AS preferred FROM jskill GROUP BY 1) USING (doc_id)""",
        "eval_coverage": f"SELECT round(avg(CAST(name IS NOT NULL AS INT)), 6) AS name, round(avg(CAST(n_education > 0 AS INT)), 6) AS education, round(avg(CAST(n_experience > 0 AS INT)), 6) AS experience, round(avg(CAST(n_projects > 0 AS INT)), 6) AS projects FROM ({_PARSED})",
        "load_summary": f"SELECT count(*) AS parsed, CAST(sum(len(skills)) AS BIGINT) AS skills, CAST(sum(n_education) AS BIGINT) AS education, CAST(sum(n_experience) AS BIGINT) AS experience, CAST(sum(n_projects) AS BIGINT) AS projects, CAST(sum(n_certifications) AS BIGINT) AS certifications FROM ({_PARSED})",
    }


def with_steps(model: str) -> dict[str, str]:
    """Each query behind the model and those steps that it or a step it needs names."""
    import re

    out = {}
    for name, q in queries().items():
        need: list[str] = []
        text = q
        for step in reversed([s for s in STEPS if s != "rhead"]):
            if re.search(rf"\b{step}\b", text):
                need.insert(0, step)
                text += STEPS[step]
        out[name] = model + "".join(f", {s} AS MATERIALIZED ({STEPS[s]})" for s in need) + "\n" + q
    return out
