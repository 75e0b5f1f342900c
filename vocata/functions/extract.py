"""Fields of resumes and adverts as columns over a line or a header text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import lines

# Patterns and word lists of the fields.
EMAIL = r"(?U)[\w.\-+]+@[\w.\-]+\.\w+"
PHONE = r"(?U)(\+?\d[\d\s().-]{7,}\d)"
DEGREE = (
    r"(?i)((?:M\.?Sc|M\.?Com|M\.?Tech|M\.?E\.?|M\.?S|M\.?A|M\.?Arch|B\.?Sc|B\.?Com|B\.?Tech|B\.?E\.?|B\.?S|B\.?A|B\.?Arch|BBA|BCA|MCA|MBA|Ph\.?D|Doctorate|Diploma|Bachelors?|Masters?))\.?"
    r"(?:\s+([A-Za-z][A-Za-z &/.\-]{0,80}?))?\s*[-—:]\s*([A-Za-z][A-Za-z .'\-]{3,80})\s*\(?(20[0-2][0-9])\)?"
)
DEGREE_TOKENS = (
    "B.Sc", "BSc", "B.Tech", "B.E.", "BE", "B.E", "B.S", "BS", "B.A", "BA", "B.Com", "BBA", "M.Sc", "MSc", "M.Tech", "ME", "M.E", "M.E.", "M.S", "MS",
    "M.A", "MA", "MBA", "MCA", "Ph.D", "PhD", "Doctorate", "Diploma", "Bachelor", "Master", "Bachelor's", "Master's",
)
_POINT = r"[A-Za-z]{3,9}\.?\s+(?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}|Present|Current"
DATE_RANGE = rf"(?i)\(?({_POINT})\)?\s*[-—to]+\s*\(?({_POINT})\)?"
ISSUERS = ("Microsoft", "Google", "AWS", "IBM", "Oracle", "SAS", "Coursera", "Udacity", "LinkedIn", "Tableau", "Databricks")
CERT_CODE = r"\(([A-Z0-9\-]+)\)"
SEPARATORS = (" - ", "—", "  ", " at ", " | ")
YEARS_RANGE = r"(?i)(\d{1,2})\s*[-–to]+\s*(\d{1,2})\s*years?"
YEARS = r"(?i)(\d{1,2})\s*(?:\+\s*)?years?"
ROLE_HINTS = {
    "data analyst": "data_analyst", "business data analyst": "data_analyst", "bi analyst": "bi_analyst", "business intelligence": "bi_analyst", "bi developer": "bi_analyst",
    "data scientist": "data_scientist", "applied scientist": "data_scientist", "data engineer": "data_engineer", "analytics engineer": "data_engineer", "data platform": "data_engineer",
    "ml engineer": "ml_engineer", "machine learning": "ml_engineer", "mlops": "ml_engineer",
}
DEFAULT_ROLE = "data_analyst"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def first_match(text: Column, pattern: str, group: int = 0) -> Column:
    """First match, null if none."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def email(text: Column) -> Column:
    return first_match(text, EMAIL)


def phone(text: Column) -> Column:
    """From the first line that has one."""
    found = F.filter(F.transform(lines(text), lambda x: F.regexp_extract(x, PHONE, 0)), lambda x: x != "")
    return F.try_element_at(found, F.lit(1))


def location(text: Column) -> Column:
    """After the last bar of the first line with an at sign and a bar."""
    line = F.try_element_at(F.filter(lines(text), lambda x: x.contains("@") & x.contains("|")), F.lit(1))
    return F.nullif(strip(F.substring_index(line, "|", -1)), F.lit(""))


def name(first_line: Column) -> Column:
    """A first line of one to four words without digit, at sign or bar; else null."""
    s = strip(first_line)
    n = F.size(F.split(s, r"(?U)\s+"))
    return F.when((s != "") & ~s.rlike(r"(?U)\d|@|\|") & (n <= 4), s)


def education(line: Column) -> Column:
    """``struct(degree, field_of_study, institution, year)`` of a line, the whole line as degree if only a degree word is in it, else null."""
    line = strip(line)
    low = F.lower(line)
    hit = line.rlike(DEGREE)
    group = lambda i: F.nullif(strip(F.regexp_extract(line, DEGREE, i)), F.lit(""))
    loose = F.exists(F.array(*[F.lit(t.lower()) for t in DEGREE_TOKENS]), lambda t: low.contains(t))
    none = F.lit(None).cast("string")
    full = F.struct(group(1).alias("degree"), group(2).alias("field_of_study"), group(3).alias("institution"), group(4).cast("int").alias("year"))
    bare = F.struct(line.alias("degree"), none.alias("field_of_study"), none.alias("institution"), F.lit(None).cast("int").alias("year"))
    return F.when(hit, full).when(loose, bare)


def dates(line: Column) -> Column:
    """``struct(start, end, is_current)`` of the first date range of a line, else null."""
    end = F.regexp_extract(line, DATE_RANGE, 2)
    return F.when(line.rlike(DATE_RANGE), F.struct(F.regexp_extract(line, DATE_RANGE, 1).alias("start"), end.alias("end"), F.lower(end).isin("present", "current").alias("is_current")))


def title_company(text: Column) -> Column:
    """``struct(title, company)`` split at the first separator, in their order, that the text has."""
    out = F.struct(strip(text).alias("title"), F.lit("").alias("company"))
    for sep in reversed(SEPARATORS):
        at = F.instr(text, sep)
        out = F.when(at > 0, F.struct(strip(F.substring_index(text, sep, 1)).alias("title"), strip(F.substr(text, at + len(sep))).alias("company"))).otherwise(out)
    return out


def certificate(line: Column) -> Column:
    """``struct(name, issuer)`` of a line; codes in brackets are dropped from the name."""
    line = strip(line)
    issuer = F.lit("")
    for x in reversed(ISSUERS):
        issuer = F.when(F.startswith(F.lower(line), F.lit(x.lower())), x).otherwise(issuer)
    return F.struct(F.when(line.rlike(CERT_CODE), strip(F.regexp_replace(line, CERT_CODE, ""))).otherwise(line).alias("name"), issuer.alias("issuer"))


def years(line: Column) -> Column:
    """Least number of years of a line: the low ends of ranges and single numbers; null if none."""
    low = F.regexp_extract_all(line, F.lit(YEARS_RANGE), F.lit(1))
    single = F.regexp_extract_all(F.regexp_replace(line, YEARS_RANGE, " "), F.lit(YEARS), F.lit(1))
    return F.array_min(F.transform(F.concat(low, single), lambda x: x.cast("int")))


def seniority(title: Column, least_years: Column) -> Column:
    t = F.lower(F.coalesce(title, F.lit("")))
    has = lambda *ws: F.exists(F.array(*[F.lit(w) for w in ws]), lambda w: t.contains(w))
    return F.when(has("junior", "entry", "graduate"), "fresher").when(has("senior", "lead", "staff", "principal"), "senior").when(least_years <= 1, "fresher").when(least_years >= 5, "senior").otherwise("mid")


def role(title: Column, hints: dict[str, str] | None = None, default: str = DEFAULT_ROLE) -> Column:
    """Role of the first hint, in their order, that the title holds."""
    t, out = F.lower(F.coalesce(title, F.lit(""))), F.lit(default)
    for hint, role_id in reversed(list((hints or ROLE_HINTS).items())):
        out = F.when(t.contains(hint), role_id).otherwise(out)
    return out


def bullet_text(line: Column) -> Column:
    """The line without hyphens and spaces before it."""
    return F.regexp_replace(line, "^[- ]+", "")


def synthetic_email(doc_id: Column) -> Column:
    """The address that a profile without one gets from its id."""
    return F.concat(doc_id, F.lit("@synthetic.local"))
