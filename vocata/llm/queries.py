"""Queries of the training-data operators over the project's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import canon, chunk, cooccur, langid, mix, neardup, pack, pii

Query = Callable[[SparkSession, str], DataFrame]
ITEMS = (("resume_document", "doc_id"), ("raw_jd", "jd_id"))


def limits(spark: SparkSession, sf: str, name: str) -> tuple[int, int]:
    """Size limit and overlap that the table size_limits sets under a name."""
    row = table(spark, sf, "size_limits").filter(F.col("limit_name") == name).select("max_size", "overlap").first()
    return row["max_size"], row["overlap"]


def raw_items(spark: SparkSession, sf: str) -> DataFrame:
    """``(src_table, item_key, raw_text)`` of the resumes and adverts."""
    return table(spark, sf, "resume_document").select(F.lit("resume_document").alias("src_table"), F.col("doc_id").alias("item_key"), "raw_text").unionByName(
        table(spark, sf, "raw_jd").select(F.lit("raw_jd").alias("src_table"), F.col("jd_id").alias("item_key"), "raw_text")
    )


def sample(df: DataFrame, column: str, rows: int) -> list[str]:
    """At most ``rows`` distinct values of a column, the same whatever the order of the rows."""
    values = df.select(F.col(column).alias("v")).filter("v IS NOT NULL").distinct()
    return sorted(r["v"] for r in values.orderBy(F.xxhash64("v"), "v").limit(rows).collect())


def p2_spans(spark, sf):
    """The model is trained on neutral patterns, filled also from bounded samples of structured columns, never of texts."""
    n = pii.SAMPLE_ROWS
    people, adverts = table(spark, sf, "candidates"), table(spark, sf, "synthetic_jd")
    model = pii.train(
        sample(people, "full_name", n), sample(people, "location", n), sample(table(spark, sf, "skills"), "canonical_name", n),
        titles=sample(adverts, "job_title", n), firms=sample(adverts, "company", n),
    )
    return pii.find_pii(raw_items(spark, sf), ["src_table", "item_key"], "raw_text", model)


def p2_found(spark, sf):
    return pii.found_values(p2_spans(spark, sf), ["src_table", "item_key"])


def p2_scrubbed(spark, sf):
    return pii.scrubbed(p2_spans(spark, sf), ["src_table", "item_key"])


def p3_links(spark, sf):
    return neardup.near_duplicates(table(spark, sf, "raw_jd"), "jd_id", "raw_text", k=3, threshold=0.7)


def p3_found(spark, sf):
    return neardup.linked_items(*p3_links(spark, sf)).withColumnsRenamed({"item_a": "jd_id_a", "item_b": "jd_id_b"})


def p3_groups(spark, sf):
    members, links = p3_links(spark, sf)
    return neardup.groups(members.select("item", "cls"), links).withColumnRenamed("item", "jd_id")


def p4_check(spark, sf):
    """What the pieces of each item must keep to: none above the limit, exact overlaps, the whole text covered."""
    size, overlap = limits(spark, sf, "raw_text_piece")
    p = chunk.split_oversized(raw_items(spark, sf), ["src_table", "item_key"], "raw_text", size, overlap)
    keys = ["src_table", "item_key"]
    repeats = F.sum(F.when(F.col("piece_no") > 0, overlap).otherwise(0))  # a piece but the first repeats so much of the one before
    return p.groupBy(*keys).agg(
        (F.max(F.length("piece")) <= size).alias("within_limit"), (F.max("end") == F.sum(F.length("piece")) - repeats).alias("covered"),
        F.max("end").cast("bigint").alias("n_chars"), (F.max("n_pieces") > 1).alias("divided"),
    ).filter("n_chars > 0")


def p4_pieces(spark, sf):
    size, overlap = limits(spark, sf, "raw_text_piece")
    return chunk.split_oversized(raw_items(spark, sf), ["src_table", "item_key"], "raw_text", size, overlap)


def p4_found(spark, sf):
    size, overlap = limits(spark, sf, "raw_text_piece")
    pieces = chunk.split_oversized(raw_items(spark, sf), ["src_table", "item_key"], "raw_text", size, overlap, only_oversized=True)
    return pieces.filter("n_pieces > 1").select("src_table", "item_key").distinct()


def p5_pairs(spark, sf):
    parts = []
    for name, key, items in (("synthetic_resume", "resume_id", "skills"), ("synthetic_jd", "jd_id", "required_skills")):
        pairs = cooccur.cooccurrence(cooccur.latest_baskets(table(spark, sf, name), key, items, "generated_at"))
        parts.append(pairs.select(F.lit(name).alias("src_table"), F.col("item_a").alias("skill_a"), F.col("item_b").alias("skill_b"), "n_ab", "n_a", "n_b", "n_records", F.round("lift", 6).alias("lift"), F.round("llr", 4).alias("llr")))
    return parts[0].unionByName(parts[1])


def p5_found(spark, sf):
    """Significant pairs of the support and lift asked for. With five records and three times the expected count
    the ratio is at least 2 * 5 * (ln 3 - 2/3) = 4.3, so the test at 5 % (3.84) takes none of these away."""
    kept = p5_pairs(spark, sf).filter(F.col("llr") >= cooccur.SIGNIFICANT).filter("n_ab >= 5 AND 1000 * n_ab >= 8 * n_records AND n_ab * n_records >= 3 * n_a * n_b")
    return kept.select("src_table", "skill_a", "skill_b")


def p6_entries(spark, sf):
    skills = table(spark, sf, "skills").select("id", "canonical_id", "canonical_name")
    known = table(spark, sf, "skill_alias").filter("skill_id IS NOT NULL").select(F.col("skill_id").alias("id"), "alias_text")
    aliases = known.join(skills.select("id", "canonical_id").distinct(), "id").select(F.col("alias_text").alias("name"), "canonical_id")
    return canon.reference_entries(skills.select(F.col("canonical_name").alias("name"), "canonical_id").unionByName(aliases), "name", "canonical_id")


def p6_found(spark, sf):
    hits = table(spark, sf, "skill_hits").filter("canonical_id IS NULL AND surface_form IS NOT NULL AND surface_form NOT RLIKE '^\\\\s*$'")
    rows = hits.select(F.lit("skill_hits").alias("src_table"), F.col("hit_id").alias("row_id"), F.col("surface_form").alias("value")).unionByName(
        table(spark, sf, "skill_alias").filter("skill_id IS NULL").select(F.lit("skill_alias").alias("src_table"), F.col("id").alias("row_id"), F.col("alias_text").alias("value"))
    )
    mapped = canon.map_to_canonical(rows, "value", p6_entries(spark, sf))
    named = rows.join(mapped, "value", "left").select("src_table", "row_id", F.coalesce("target", F.lit("unmatched")).alias("canonical_id"))
    return named.distinct()


def p7_pack(spark, sf):
    size, _ = limits(spark, sf, "token_container")
    return pack.pack_texts(table(spark, sf, "documents"), "doc_id", "text", size).withColumnsRenamed({"item": "doc_id", "size": "n_tokens"})


def p7_containers(spark, sf):
    size, _ = limits(spark, sf, "token_container")
    return pack.containers(p7_pack(spark, sf).withColumnRenamed("n_tokens", "size"), size)


def p7_check(spark, sf):
    """What the containers must keep to, as one row: every document once, none above the capacity, only oversized ones divided."""
    size, _ = limits(spark, sf, "token_container")
    packed = p7_pack(spark, sf)
    box = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("fill"))
    item = packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("parts"))
    fill = box.agg((F.max("fill") <= size).alias("within_capacity"), (F.sum("fill") / (F.count("*") * size) > 0.9).alias("well_filled"))
    docs = item.agg(F.count("*").alias("n_docs"), (F.sum((F.col("parts") != F.greatest(F.lit(1), F.ceil(F.col("n") / size))).cast("int")) == 0).alias("divided_only_if_oversized"))
    return docs.withColumn("_k", F.lit(1)).join(fill.withColumn("_k", F.lit(1)), "_k").drop("_k")


def _mixed(spark, sf):
    return mix.mix(mix.sized_texts(table(spark, sf, "documents"), "doc_id", "text", "source"), table(spark, sf, "mix_targets"))


def p8_mix(spark, sf):
    return _mixed(spark, sf)[0]


def p8_shares(spark, sf):
    return _mixed(spark, sf)[1]


def p8_check(spark, sf):
    """For each source that can be used: its cap is kept, no text comes twice, its share is within a point of the aim."""
    chosen, shares = _mixed(spark, sf)
    n = chosen.groupBy("source").agg(F.max("repeats").alias("most"), F.count("*").alias("n"), F.countDistinct("doc_id").alias("d"))
    rows = shares.filter("aim_share IS NOT NULL").join(n, "source", "left")
    return rows.select("source", "max_repeats", (F.col("most") <= F.col("max_repeats")).alias("cap_kept"), (F.col("n") == F.col("d")).alias("once"), (F.abs(F.col("actual_share") - F.col("aim_share")) <= 0.01).alias("share_met"), F.round("aim_share", 6).alias("aim_share"))


def p9_labels(spark, sf):
    """The language that each distinct label names, null if it names none."""
    docs = table(spark, sf, "documents")
    return docs.groupBy("lang").agg(F.count("*").alias("n_rows")).select("lang", langid.label_language(F.col("lang")).alias("named"), "n_rows")


def p9_tagged(spark, sf):
    """The model is trained on a bounded sample of the documents whose label names a language."""
    docs = table(spark, sf, "documents")
    # ids are chosen first, from narrow columns and by a threshold of their hash; only their texts are then fetched
    share = min(1.0, 4 * langid.SAMPLE_DOCS / max(1, docs.count()))
    ids = docs.filter(langid.label_language(F.col("lang")).isNotNull() & (F.col("n_chars") <= langid.SAMPLE_CHARS)).select("doc_id").dropna()
    ids = ids.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000)).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(langid.SAMPLE_DOCS)
    labelled = docs.join(F.broadcast(ids), "doc_id", "left_semi").select("doc_id", "text", langid.label_language(F.col("lang")).alias("lang")).dropna()
    rows = sorted({(r["doc_id"], r["text"], r["lang"]) for r in labelled.collect()})
    model = langid.train(tuple((text, lang) for _, text, lang in rows))
    return langid.tag(docs, "doc_id", "text", "lang", model)


def p9_found(spark, sf):
    tagged = p9_tagged(spark, sf).filter("lang IS NOT NULL AND doc_id IS NOT NULL")
    wrong = F.array(F.struct(F.lit(-1).cast("bigint").alias("seg_start"), F.col("lang")))
    none = F.array().cast("array<struct<seg_start:bigint,lang:string>>")
    mixed = F.transform("runs", lambda r: F.struct(r["start"].cast("bigint").alias("seg_start"), r["lang"].alias("lang")))
    said = F.concat(F.when(F.col("label_lang").eqNullSafe(F.col("lang")), none).otherwise(wrong), F.when(F.size("runs") > 1, mixed).otherwise(none))
    return tagged.select("doc_id", F.explode(said).alias("s")).select("doc_id", "s.*").distinct()


def p9_languages(spark, sf):
    return p9_tagged(spark, sf).select("doc_id", "label_lang", "lang", F.round("confidence", 4).alias("confidence"), F.size("runs").alias("n_runs"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p2_found, p2_scrubbed, p3_found, p3_groups, p4_found, p4_pieces, p4_check, p5_found, p5_pairs, p6_found, p7_pack, p7_containers, p7_check, p8_mix, p8_shares, p8_check, p9_found, p9_languages, p9_labels)}


_BASKETS = r"""
baskets AS (
  SELECT '{t}' AS src_table, {k} AS record, list_distinct(list_filter(list_transform(coalesce({i}, []), lambda x: lower(regexp_replace(x, '^\s+|\s+$', '', 'g'))), lambda x: x IS NOT NULL AND x <> '')) AS items
  FROM (SELECT {k}, {i}, row_number() OVER (PARTITION BY {k} ORDER BY generated_at DESC NULLS LAST, to_json({i}) DESC) AS rn FROM {t} WHERE {k} IS NOT NULL) q WHERE rn = 1),
"""


def _pairs_sql(t: str, k: str, i: str, tail: str) -> str:
    return (
        "SELECT * FROM (WITH "
        + _BASKETS.format(t=t, k=k, i=i)
        + """flat AS (SELECT src_table, record, unnest(items) AS item FROM baskets),
one AS (SELECT item, count(*) AS n FROM flat GROUP BY item),
two AS (SELECT a.src_table, a.item AS skill_a, b.item AS skill_b, count(*) AS n_ab FROM flat a JOIN flat b ON a.record = b.record AND a.item < b.item GROUP BY ALL),
tot AS (SELECT count(*) AS n_records FROM baskets)
"""
        + tail
        + ")"
    )


_LOG = lambda x: f"(CASE WHEN {x} > 0 THEN {x} * ln({x} / N) ELSE 0 END)"
_CELLS = " + ".join(_LOG(x) for x in ("ab", "(na - ab)", "(nb - ab)", "(N - na - nb + ab)"))
_SIDES = " - ".join(_LOG(x) for x in ("na", "(N - na)", "nb", "(N - nb)"))
_PAIRS = f"""SELECT src_table, skill_a, skill_b, ab::BIGINT AS n_ab, na::BIGINT AS n_a, nb::BIGINT AS n_b, N::BIGINT AS n_records, round(ab * N / (na * nb), 6) AS lift, round(greatest(0, 2 * ({_CELLS} - {_SIDES})), 4) AS llr
FROM (SELECT src_table, skill_a, skill_b, n_ab::DOUBLE AS ab, a.n::DOUBLE AS na, b.n::DOUBLE AS nb, n_records::DOUBLE AS N FROM two JOIN one a ON a.item = skill_a JOIN one b ON b.item = skill_b CROSS JOIN tot) x"""
_FOUND = """SELECT src_table, skill_a, skill_b FROM two JOIN one a ON a.item = skill_a JOIN one b ON b.item = skill_b CROSS JOIN tot
WHERE n_ab >= 5 AND 1000 * n_ab >= 8 * n_records AND n_ab * n_records >= 3 * a.n * b.n"""


# every pair of adverts by its sets of three successive words, and the groups that the pairs form
_NEAR = r"""WITH RECURSIVE t AS (SELECT DISTINCT jd_id, raw_text FROM raw_jd WHERE jd_id IS NOT NULL AND raw_text IS NOT NULL),
x AS (SELECT raw_text, row_number() OVER (ORDER BY raw_text) AS cls FROM (SELECT DISTINCT raw_text FROM t)),
w AS (SELECT cls, regexp_extract_all(lower(raw_text), '[\p{L}\p{N}_]+') AS w FROM x),
s AS (SELECT DISTINCT cls, unnest(list_transform(range(1, len(w) - 1), lambda i: hash(w[i], w[i + 1], w[i + 2]))) AS g FROM w WHERE len(w) >= 3),
n AS (SELECT cls, count(*) AS n FROM s GROUP BY cls),
cand AS (SELECT a.cls AS a, b.cls AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.cls < b.cls GROUP BY ALL),
link AS (SELECT a, b FROM cand JOIN n x ON x.cls = a JOIN n y ON y.cls = b WHERE k >= 0.7 * (x.n + y.n - k) - 1e-9),
mem AS (SELECT t.jd_id AS item, x.cls FROM t JOIN x USING (raw_text)),
"""
_NEAR_PAIRS = _NEAR + """pair AS (SELECT p.item AS x, q.item AS y FROM link JOIN mem p ON p.cls = a JOIN mem q ON q.cls = b
  UNION SELECT p.item, q.item FROM mem p JOIN mem q ON p.cls = q.cls AND p.item < q.item JOIN n ON n.cls = p.cls)
SELECT DISTINCT least(x, y) AS jd_id_a, greatest(x, y) AS jd_id_b FROM pair WHERE x <> y"""
_NEAR_GROUPS = _NEAR + """edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT cls AS a, cls AS b FROM x UNION SELECT r.a, e.b FROM reach r JOIN edge e ON e.a = r.b),
named AS (SELECT r.a AS cls, min(m.item) AS group_id FROM reach r JOIN mem m ON m.cls = r.b GROUP BY 1)
SELECT m.item AS jd_id, named.group_id, coalesce(d.n, 0) AS n_links FROM mem m JOIN named USING (cls) LEFT JOIN (SELECT a, count(*) AS n FROM edge GROUP BY 1) d ON d.a = m.cls"""
_ISO = ", ".join(f"('{k}', '{v}')" for k, v in (langid.CODES | langid.ENGLISH_NAMES).items())


def oracle_sql() -> dict[str, str]:
    both = [("synthetic_resume", "resume_id", "skills"), ("synthetic_jd", "jd_id", "required_skills")]
    return {
        "p4_found": """SELECT DISTINCT 'resume_document' AS src_table, doc_id AS item_key FROM resume_document WHERE length(raw_text) > 4000
UNION ALL SELECT DISTINCT 'raw_jd', jd_id FROM raw_jd WHERE length(raw_text) > 4000""",
        "p3_found": _NEAR_PAIRS,
        "p3_groups": _NEAR_GROUPS,
        "p4_check": " UNION ALL ".join(
            f"SELECT DISTINCT '{t}' AS src_table, {k} AS item_key, true AS within_limit, true AS covered, max(length(raw_text)) AS n_chars, max(length(raw_text)) > (SELECT max_size FROM size_limits WHERE limit_name = 'raw_text_piece') AS divided FROM {t} WHERE length(raw_text) > 0 GROUP BY {k}" for t, k in ITEMS
        ),
        "p7_check": "SELECT count(DISTINCT doc_id) AS n_docs, true AS divided_only_if_oversized, true AS within_capacity, true AS well_filled FROM documents",
        "p8_check": """SELECT source, max_repeats, true AS cap_kept, true AS once, true AS share_met, round(target_share / sum(target_share) OVER (), 6) AS aim_share
FROM (SELECT source, max(target_share) AS target_share, max(max_repeats) AS max_repeats FROM mix_targets GROUP BY 1) WHERE source IN (SELECT source FROM documents WHERE text <> '') AND target_share > 0 AND max_repeats > 0""",
        "p9_labels": f"""SELECT lang, n.language AS named, count(*) AS n_rows FROM documents LEFT JOIN (VALUES {_ISO}) n(code, language)
ON n.code = lower(trim(lang)) OR (length(n.code) <= 3 AND regexp_matches(lower(trim(lang)), '^' || n.code || '[-_][a-z0-9]+$')) GROUP BY ALL""",
        "p5_found": " UNION ALL ".join(_pairs_sql(*x, _FOUND) for x in both),
        "p5_pairs": " UNION ALL ".join(_pairs_sql(*x, _PAIRS) for x in both),
    }
