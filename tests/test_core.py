"""Small fixtures for operators, with nulls, repeated rows, empty tables and clashing names."""

import datetime as dt
import io
import zipfile

from pyspark.sql import functions as F

from vocata.functions import extract as x
from vocata.functions import text as t
from vocata.operators import documents as d
from vocata.operators import evaluate, merge
from vocata.operators.references import orphan_references, orphan_report, target_state
from vocata.plans import pipeline
from vocata.session import table
from vocata.sources import readers
from vocata.streaming import intake

DAY = lambda n: dt.datetime(2020, 1, n)


def test_references_simple_partial_full(spark):
    tgt = spark.createDataFrame([(1, "a", DAY(1), 9), (2, "b", DAY(5), 9), (3, None, DAY(1), 9), (1, "a", DAY(2), 9)], "x int, y string, at timestamp, row_id int")
    refs = spark.createDataFrame(
        [(1, 1, "a", DAY(3), 0), (2, 1, "b", DAY(3), 0), (3, None, "b", DAY(9), 0), (4, None, "b", DAY(3), 0), (5, None, None, DAY(3), 0), (6, 2, None, None, 0), (7, 7, None, DAY(3), 0), (1, 1, "a", DAY(3), 0)],
        "id int, fx int, fy string, made timestamp, k0 int",
    )
    state = target_state(tgt, ["x", "y"], "at")
    got = {m: {r["row_id"]: r["reason"] for r in orphan_references(refs, ["fx", "fy"], "id", state, "made", m).collect()} for m in ("simple", "partial", "full")}
    assert got["simple"] == {2: "absent"}
    assert got["partial"] == {2: "absent", 4: "later", 7: "absent"}
    assert got["full"] == {2: "absent", 3: "mixed_nulls", 4: "mixed_nulls", 6: "mixed_nulls", 7: "mixed_nulls"}


def test_references_removed_hot_and_empty(spark):
    tgt = spark.createDataFrame([(1, DAY(1)), (2, DAY(4)), (3, DAY(1)), (4, None)], "id int, at timestamp")
    gone = spark.createDataFrame([(1, DAY(2)), (1, DAY(2)), (2, DAY(3)), (9, DAY(1)), (3, None)], "e int, at timestamp")
    state = target_state(tgt, ["id"], "at", gone, ["e"], "at")
    refs = spark.createDataFrame([(i, k, DAY(9)) for i, k in enumerate([1] * 5 + [2, 3, 4, 5])], "id int, k int, at timestamp")
    found = orphan_references(refs, ["k"], "id", state, "at", hot_rows=2)
    assert {(r["row_id"], r["reason"]) for r in found.collect()} == {*((i, "removed") for i in range(5)), (8, "absent")}
    rep = orphan_report(found.withColumns({"src_table": F.lit("t"), "ref_field": F.lit("k")})).collect()
    assert {(r["reason"], r["n_rows"], r["n_keys"]) for r in rep} == {("removed", 5, 1), ("absent", 1, 1)}
    assert orphan_references(refs.limit(0), ["k"], "id", state, "at").count() == 0
    assert orphan_references(refs, ["k"], "id", state.limit(0), "at").count() == 9


def test_references_hot_split(spark, monkeypatch):
    from vocata.operators import references as r

    monkeypatch.setattr(r, "BROADCAST_ROWS", 3)
    tgt = spark.range(10).selectExpr("id", "timestamp'2020-01-01' AS at")
    refs = spark.range(200).selectExpr("id", "CASE WHEN id < 150 THEN 3 ELSE id END AS k", "timestamp'2020-02-01' AS at")
    assert orphan_references(refs, ["k"], "id", target_state(tgt, ["id"], "at"), "at", hot_rows=50).count() == 50


def test_merges(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), (None, 3, "z")], "k string, v int, w string")
    new = spark.createDataFrame([("b", 9, "n"), ("b", 8, "m"), ("c", 7, "o"), (None, 6, "p")], "k string, v int, w string")
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert rows(merge.upsert(old, new, ["k"], ["v"], ["v"])) == sorted([("a", 1, "x"), ("b", 8, "y"), (None, 3, "z"), ("c", 7, "o")], key=repr)
    assert rows(merge.insert_ignore(old, new, ["k"], ["v"])) == sorted([("a", 1, "x"), ("b", 2, "y"), (None, 3, "z"), ("c", 7, "o")], key=repr)
    once = merge.insert_ignore(old, new, ["k"], ["v"])
    assert rows(merge.insert_ignore(once, new, ["k"], ["v"])) == rows(once)
    assert rows(merge.replace_children(old, new.filter("k = 'b'"), "k")) == sorted([("a", 1, "x"), (None, 3, "z"), ("b", 9, "n"), ("b", 8, "m")], key=repr)
    ev = spark.createDataFrame([(1, "explicit", "skills"), (2, "inferred", "projects"), (3, "inferred", None)], "k int, evidence string, source_section string")
    up = spark.createDataFrame([(1, "inferred", "other"), (2, "explicit", "skills"), (2, "inferred", "a"), (4, "inferred", "b")], ev.schema)
    assert rows(merge.upgrade_evidence(ev, up, ["k"])) == rows(spark.createDataFrame([(1, "explicit", "skills"), (2, "explicit", "skills"), (3, "inferred", None), (4, "inferred", "b")], ev.schema))
    st = spark.createDataFrame([(1, "pending"), (2, "pending"), (3, "parsed"), (4, "parsed")], "k int, parsed_status string")
    ids = lambda *v: spark.createDataFrame([(i,) for i in v], "k int")
    assert dict(rows(merge.flip_status(st, ids(1, 3), ids(4), "k"))) == {1: "parsed", 2: "pending", 3: "parsed", 4: "failed"}


def test_evidence_upgrade_keeps_undated_rows(spark):
    sf = "/root/testdata/sf0.01"
    whole = table(spark, sf, "candidate_skills").dropna(subset=["candidate_id", "skill_id"]).groupBy("candidate_id", "skill_id").agg(F.min("evidence").alias("evidence"))
    got = pipeline.evidence_upgrade(spark, sf).select("candidate_id", "skill_id", "evidence")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect()))  # explicit, if any row of the pair is


def test_orphan_resumes(spark, tmp_path):
    spark.createDataFrame([("a_0001", "x"), ("a_0001", "y"), ("b_007", "x"), ("b_007", "y"), ("unnumbered", "x"), (None, "x")], "doc_id string, source_path string").write.parquet(f"{tmp_path}/resume_document.parquet")
    spark.createDataFrame([(1,), (1,), (None,)], "id long").write.parquet(f"{tmp_path}/candidates.parquet")
    assert [tuple(r) for r in pipeline.dq_orphan_resumes(spark, str(tmp_path)).collect()] == [("resume_document", 2)]


def test_missing_tables_of_a_folder(spark, tmp_path):
    for n in pipeline.TABLES:
        if n not in ("skills", "raw_jd"):
            (tmp_path / f"{n}.parquet").mkdir()
    (tmp_path / "skills.csv").touch()
    assert sorted(r[0] for r in pipeline.dq_missing_tables(spark, str(tmp_path)).collect()) == ["career_readiness", "match_results", "raw_jd", "skills"]


def test_field_queries_read_the_texts(spark, tmp_path):
    cv = "Ann Lee\n\nEXPERIENCE\nAnalyst | Acme Corp (Mar 2019 - Present)\n- Built reports\nIntern at Beta Ltd (2015 - 2017)\n"
    ad = "Data Analyst\n\nRequirements\n- 4-6 years of SQL\n- 3+ years of Python\n\nPreferred Qualifications\n- 1 year of R\n"
    spark.createDataFrame([("r1", cv)], "doc_id string, raw_text string").write.parquet(f"{tmp_path}/resume_document.parquet")
    spark.createDataFrame([("j1", ad), ("j2", "Data Analyst\n\nRequirements\n- SQL\n")], "jd_id string, raw_text string").write.parquet(f"{tmp_path}/raw_jd.parquet")
    rows = lambda q, *c: sorted((tuple(r) for r in q(spark, str(tmp_path)).select(*c).collect()), key=repr)
    assert rows(pipeline.jd_text_years, "doc_id", "years_min") == [("j1", 3), ("j2", None)]
    assert rows(pipeline.split_title_company, "doc_id", "title", "company") == [("r1", "Analyst", "Acme Corp"), ("r1", "Intern", "Beta Ltd")]
    days = [("end", "2017", dt.date(2017, 1, 1)), ("end", "Present", None), ("start", "2015", dt.date(2015, 1, 1)), ("start", "Mar 2019", dt.date(2019, 3, 1))]
    assert rows(pipeline.resume_month_dates, "edge", "text", "day") == sorted(days, key=repr)


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("r")).first()["r"]


def test_text_functions(spark):
    assert one(spark, "a — b’s “c” •", t.clean_punct) == "a - b's \"c\"  "
    assert one(spark, "exam-\n  ple Foo-\nBar", t.dehyphenate) == "example Foo-\nBar"
    assert one(spark, " a \t b \n\n c", t.collapse_ws) == "a b\nc"
    assert one(spark, "Café ﬁne", t.ascii_fold) == "Cafe fine"
    assert one(spark, None, t.clean_document) is None and one(spark, "", t.clean_document) == ""
    got = t.scrub(spark.createDataFrame([("mail a@b.com or a@b.com, 123-45-6789, http://x.y/z",), (None,), ("",)], "t string"), "t").collect()
    s = got[0]["scrubbed"]
    assert (got[0]["email"], got[0]["ssn"], got[0]["url"], got[1]["scrubbed"], got[1]["email"], got[2]["scrubbed"]) == (2, 1, 1, None, 0, "")
    assert "a@b.com" not in s and s.count("@example.com") == 2 and "redacted_ssn" in s and "https://example.com/page_" in s
    assert str(one(spark, "Jul 2017", t.month_date)) == "2017-07-01" and str(one(spark, "2017", t.month_date)) == "2017-01-01" and one(spark, "x", t.month_date) is None


def test_extract(spark):
    assert one(spark, "5+ years", x.years) == 5 and one(spark, "3-5 years", x.years) == 3 and one(spark, "none", x.years) is None
    assert one(spark, "né@x.org", x.email) == "né@x.org"
    assert one(spark, "A | a@b.c | Rome, Italy", x.location) == "Rome, Italy"
    e = one(spark, "MSc in Data Science - Some University (2021)", x.education)
    assert (e["degree"], e["year"]) == ("MSc", 2021) and "Data Science" in e["field_of_study"] and "University" in e["institution"]
    assert one(spark, "mathematics", x.education)["degree"] == "mathematics"
    assert one(spark, "BI Analyst - Blake and Sons", x.title_company).asDict() == {"title": "BI Analyst", "company": "Blake and Sons"}
    r = one(spark, "Analyst (Mar 2019 - Present)", x.dates)
    assert (r["start"], r["end"], r["is_current"]) == ("Mar 2019", "Present", True)
    assert one(spark, "Microsoft Azure (AZ-900)", x.certificate).asDict() == {"name": "Microsoft Azure", "issuer": "Microsoft"}
    assert one(spark, "Senior Analyst", lambda c: x.seniority(c, F.lit(None).cast("int"))) == "senior"


def test_skill_match_and_segments(spark):
    skills = spark.createDataFrame([(1, "sql", "SQL", True), (2, "python", "Python", True), (3, "r_language", "R", True), (4, "power_bi", "Power BI", True), (5, "old", "Old", False)], "id int, canonical_id string, canonical_name string, is_active boolean")
    alias = spark.createDataFrame([("T-SQL", 1), ("PBI", 4)], "alias_text string, skill_id int")
    text = "Jane Doe\njane@x.com | Rome\nSkills\nSQL,Python,Power BI. Old\nparser and router\nExperience\nAnalyst - Acme (Jan 2019 - Present)\nBuilt T-SQL jobs\n- and more\nProjects\nProject: one\nUsed PBI"
    docs = spark.createDataFrame([("d", text), ("d", text), ("e", None), ("f", "")], "doc_id string, raw_text string")
    rows = d.document_lines(docs, "doc_id", "raw_text")
    index = d.skill_index(skills, alias)
    seg = d.segment(rows)
    assert {r["section"] for r in seg.collect()} == {"header", "skills", "experience", "projects"}
    hits = d.match_skills(seg, index)
    assert {r["canonical_id"] for r in hits.filter("section = 'skills'").collect()} == {"sql", "python", "power_bi"}
    assert [r["surface_form"] for r in hits.filter("section = 'experience'").collect()] == ["T-SQL"]
    p = d.parse_resume(rows, index).collect()
    assert len(p) == 1 and p[0]["skills"] == ["power_bi", "python", "sql"] and p[0]["n_experience"] == 1 and p[0]["name"] == "Jane Doe" and p[0]["n_projects"] == 1
    e = d.experience_entries(seg).first()
    assert (e["title"], e["company"], e["start"], e["is_current"]) == ("Analyst", "Acme", "Jan 2019", True) and len(e["bullets"]) == 2
    jd = spark.createDataFrame([("j", "Senior Data Analyst\nAcme | Rome\nRequirements\n- 3-5 years of SQL\nNice to have\n- Python and SQL")], "doc_id string, raw_text string")
    j = d.parse_jd(d.document_lines(jd, "doc_id", "raw_text"), index).first()
    assert (j["job_title"], j["company"], j["location"], j["years_min"], j["seniority"], j["role_id"], j["required"], j["preferred"]) == ("Senior Data Analyst", "Acme", "Rome", 3, "senior", "data_analyst", ["sql"], ["python"])


def test_scores(spark):
    s = "doc_id string, canonical_id string"
    pred, truth = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y"), ("z", "q")], s), spark.createDataFrame([("a", "x"), ("b", "y")], s)
    roles = spark.createDataFrame([("a", "r"), ("b", "r")], "doc_id string, role_id string")
    o = evaluate.scores(pred, truth, roles).filter("overall").first()
    assert (o["tp"], o["fp"], o["fn"], o["f1"]) == (1, 1, 1, 0.5)


def test_sources_and_stream(spark, tmp_path):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = f'<w:document xmlns:w="{w}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Skills</w:t></w:r></w:p><w:p><w:r><w:t>Project: x</w:t></w:r></w:p></w:body></w:document>'
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", body)
    (tmp_path / "a.docx").write_bytes(buf.getvalue())
    (tmp_path / "b.docx").write_bytes(b"broken")
    (tmp_path / "c.txt").write_text("Title\nbody")
    got = {(r["doc_id"], r["text"], r["kind"]) for r in readers.resume_blocks(spark, str(tmp_path)).collect()}
    assert got == {("a", "Skills", "heading"), ("a", "Project: x", "subheading"), ("b", None, "normal")}
    assert [r["jd_id"] for r in readers.job_texts(spark, str(tmp_path)).collect()] == ["c"]
    assert readers.split_statements("-- x\nSELECT 1;\nSELECT ';x';\n") == ["SELECT 1", "SELECT ';x'"]
    tree = {"industries": [{"id": "i", "name": "I", "roles": [{"id": "r", "name": "R", "categories": [{"id": "c", "name": "C", "skills": [{"id": "s", "name": "S", "importance": "high", "sub_skills": ["u"]}]}]}]}]}
    assert [(r["node_type"], r["parent_id"]) for r in readers.taxonomy_nodes(spark, tree).orderBy("id").collect()] == [("industry", None), ("role", 1), ("category", 2), ("skill", 3), ("sub_skill", 4)]
    schema = "doc_id string, raw_text string, arrived_at timestamp"
    spark.createDataFrame([("a", "x", DAY(1)), ("a", "x", DAY(1)), ("b", " ", DAY(1))], schema).write.parquet(str(tmp_path / "in"))
    q = intake.run(intake.new_resumes(spark, str(tmp_path / "in"), schema), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert {(r["doc_id"], r["parsed_status"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("a", "parsed"), ("b", "failed")}


def test_surface_in_another_script(spark):
    skills = spark.createDataFrame([(1, "analysis", "分析", True), (2, "sql", "SQL", True)], "id int, canonical_id string, canonical_name string, is_active boolean")
    index = d.skill_index(skills, spark.createDataFrame([], "alias_text string, skill_id int"))
    rows = spark.createDataFrame([("a", "skills", 0, "数据分析 and sql"), ("b", "skills", 0, "分析"), ("c", "skills", 0, "")], "doc_id string, section string, pos int, text string")
    assert sorted((r["doc_id"], r["canonical_id"]) for r in d.match_skills(rows, index).collect()) == [("a", "analysis"), ("a", "sql"), ("b", "analysis")]


def test_parse_keeps_entries_and_documents_of_headings_alone(spark):
    skills = spark.createDataFrame([(1, "sql", "SQL", True)], "id int, canonical_id string, canonical_name string, is_active boolean")
    index = d.skill_index(skills, spark.createDataFrame([], "alias_text string, skill_id int"))
    text = "Ann Lee\nEXPERIENCE\nAnalyst - Acme (Jan 2019 - Present)\n- Built reports\nIntern at Beta\n(2015 - 2016)\nEDUCATION\nMSc in Data - Some College (2014)\nPROJECTS\nProject: one\nfirst\nuses SQL\nCERTIFICATIONS\nGoogle Cloud (GC-1)"
    docs = spark.createDataFrame([("d", text), ("h", "Skills\nProjects")], "doc_id string, raw_text string")
    rows = d.document_lines(docs, "doc_id", "raw_text")
    p = {r["doc_id"]: r for r in d.parse_resume(rows, index).collect()}
    assert set(p) == {"d", "h"} and (p["h"]["name"], p["h"]["skills"], p["h"]["n_projects"]) == (None, [], 0)
    r = p["d"]
    assert [(e["title"], e["company"], e["start"], e["bullets"]) for e in r["experience"]] == [("Analyst", "Acme", "Jan 2019", ["- Built reports", "Intern at Beta"])]
    assert [(e["degree"], e["institution"], e["year"]) for e in r["education"]] == [("MSc", "Some College", 2014)]
    assert [(e["name"], e["description"]) for e in r["projects"]] == [("Project: one", "uses SQL")] and [c["issuer"] for c in r["certifications"]] == ["Google"]
    assert [x["tech_stack"] for x in d.project_skills(d.segment(rows), index).collect()] == ['["sql"]']
    j = d.parse_jd(d.document_lines(spark.createDataFrame([("j", "Analyst\nRequirements\n- know SQL"), ("k", "Requirements")], "doc_id string, raw_text string"), "doc_id", "raw_text"), index)
    assert sorted((x["doc_id"], x["job_title"], x["requirements"], x["required"]) for x in j.collect()) == [("j", "Analyst", ["know SQL"], ["sql"]), ("k", None, [], [])]


def test_defaults_and_outcomes(spark):
    df = spark.createDataFrame([("a", " x "), ("b", " "), ("c", None), ("c", None)], "k string, t string")
    assert [r[0] for r in df.select(merge.or_default(F.col("t"), "none")).collect()] == ["x", "none", "none", "none"]
    got = {(r["doc_id"], r["error"], r["outcome"], r["n_rows"]) for r in d.parse_outcome(df, "k", "t").collect()}
    assert got == {("a", None, "parsed", 1), ("b", "empty text", "failed", 1), ("c", "no text", "failed", 2)}


def test_salted_join(spark):
    from vocata.session import salted_join

    left = spark.range(40).selectExpr("id", "id % 3 AS k")
    right = spark.createDataFrame([(0, "a"), (0, "b"), (1, "c")], "k long, v string")
    rows = lambda df: sorted(map(tuple, df.select("id", "k", "v").collect()))
    assert rows(salted_join(left, right, ["k"], "id")) == rows(left.join(right, "k"))


def test_store(spark, tmp_path):
    import pytest

    from vocata.sources import store

    folder = str(tmp_path / "store")
    seed = {"skills": spark.createDataFrame([(1, "sql", "SQL", None, True, None, None)], store.SCHEMAS["skills"])}
    assert store.create_tables(spark, folder, seed) == list(store.SCHEMAS) and store.create_tables(spark, folder) == []
    assert spark.read.parquet(f"{folder}/skills.parquet").count() == 1 and spark.read.parquet(f"{folder}/candidates.parquet").count() == 0
    assert store.create_tables(spark, folder, reset=True) == list(store.SCHEMAS) and spark.read.parquet(f"{folder}/skills.parquet").count() == 0
    df = spark.createDataFrame([("a", "one\ntwo"), ("b", "three"), (None, "x"), ("c", None)], "k string, t string")
    store.write_labels(df, str(tmp_path / "labels"))
    assert spark.read.schema("k string, t string").json(str(tmp_path / "labels")).count() == 4
    store.write_texts(df, "k", "t", str(tmp_path / "texts"))
    assert sorted(map(tuple, spark.read.text(str(tmp_path / "texts"), wholetext=True).select("k", "value").collect())) == [("a", "one\ntwo\n"), ("b", "three\n")]
    with pytest.raises(ValueError):
        readers.resume_format(spark, "x/none.txt")
    with pytest.raises(FileNotFoundError):
        readers.resume_format(spark, f"{tmp_path}/none.docx")
    with pytest.raises(ValueError):
        readers.job_text(spark, "j", " \n")
    assert readers.job_text(spark, "j", "Analyst").first()["raw_text"] == "Analyst"


def moved(df):
    """Rows that the shuffles of the plan of ``df`` write."""

    def walk(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(node.plan())
        n, below = "shuffleRecordsWritten", node.children()
        return (node.metrics().apply(n).value() if node.metrics().contains(n) else 0) + sum(walk(below.apply(i)) for i in range(below.size()))

    rows = df.collect()
    return rows, walk(df._jdf.queryExecution().executedPlan())


def test_blocked(spark):
    from vocata.session import blocked

    left = spark.range(50).selectExpr("id AS a", "CASE WHEN id < 40 THEN 'hot' WHEN id < 48 THEN 'x' END AS k")
    right = spark.range(30).selectExpr("id AS b", "CASE WHEN id < 20 THEN 'hot' WHEN id < 25 THEN 'y' WHEN id < 28 THEN 'x' END AS k")
    one, two, n = blocked(left, right, "k", "a", "b", rows=7)
    rows = lambda df: sorted((r["a"], r["b"]) for r in df.collect())
    assert rows(one.join(two, ["k", "_a", "_b"])) == rows(left.join(right, "k"))
    assert n == 6 * 3 + 2 * 1
    assert blocked(left, right.filter("k = 'y'"), "k", "a", "b")[2] == 0


def test_match_results_moves_no_pairs(spark, tmp_path):
    """Every candidate shares skill 1 with every posting; skill sets of more than one mask word."""
    from vocata.plans import star

    at = ("timestamp'2020-01-01' AS created_at", "timestamp'2020-01-01' AS updated_at")
    write = lambda df, n: df.write.parquet(f"{tmp_path}/{n}.parquet")
    write(spark.range(1, 301).selectExpr("id", "'n' AS full_name", "'e' AS email", "'l' AS location", "CASE WHEN id > 295 THEN NULL WHEN id = 295 THEN 'none' ELSE 'r' END AS target_role_id", "'b' AS seniority_band", "'s' AS source", *at), "candidates")
    has = [(c, s) for c in range(1, 301) for s in {1, c % 150 + 1}]
    write(spark.createDataFrame(has, "candidate_id long, skill_id long"), "candidate_skills")
    write(spark.range(1, 151).selectExpr("id", "concat('s', id) AS canonical_id", "concat('S', id) AS canonical_name", "id AS taxonomy_id", *at), "skills")
    wants = {j: sorted({1, *range(j * 3 + 2, j * 3 + 5)}) for j in range(48)}
    ads = [(f"j{j}", "r", "t", "c", "b", 1, [f"s{s}" for s in w], ["s1"], "2020") for j, w in wants.items()]
    write(spark.createDataFrame(ads, "jd_id string, target_role_id string, job_title string, company string, seniority_band string, min_years_experience int, required_skills array<string>, preferred_skills array<string>, generated_at string"), "synthetic_jd")
    rows, n = moved(star.match_results(spark, str(tmp_path)))
    got = {(r["candidate_id"], r["job_id"]): (r["skill_overlap_pct"], r["missing_skill_count"]) for r in rows}
    both = {(c, f"j{j}"): len({1, c % 150 + 1} & {*w}) for c in range(1, 295) for j, w in wants.items()}
    assert got == {k: (round(100 * v / 4, 2), 4 - v) for k, v in both.items()} and len(rows) == len(got)
    assert n < len(got) / 10, f"{n} rows moved for {len(got)} pairs"


def test_match_results_writes_no_block_twice(spark, tmp_path, monkeypatch):
    """Blocks of either side meet without being moved for it, and rows of a posting with equal overlap follow one another."""
    from itertools import groupby

    from vocata.plans import star

    at = ("timestamp'2020-01-01' AS created_at", "timestamp'2020-01-01' AS updated_at")
    write = lambda df, n: df.write.parquet(f"{tmp_path}/{n}.parquet")
    role = lambda i: "pqr"[i % 3]
    write(spark.range(90).selectExpr("id", "'n' AS full_name", "'e' AS email", "'l' AS location", "substr('pqr', int(id % 3) + 1, 1) AS target_role_id", "'b' AS seniority_band", "'s' AS source", *at), "candidates")
    has = {c: {63, c % 64, c * 7 % 70} for c in range(90)}
    write(spark.createDataFrame([(c, s) for c, v in has.items() for s in [*v, 63]], "candidate_id long, skill_id long"), "candidate_skills")
    write(spark.range(70).selectExpr("id", "concat('s', id) AS canonical_id", "concat('S', id) AS canonical_name", "id AS taxonomy_id", *at), "skills")
    every = {*range(70)}
    wants = {j: every if j < 3 else {63, j, 64 + j % 6} if j % 2 else {j, j + 1, j + 2} for j in range(40)}
    ads = [(f"j{j}", role(j), "t", "c", "b", 1, [f"s{s}" for s in [*w, *w]], ["s1"], "2020") for j, w in wants.items()]
    write(spark.createDataFrame(ads, "jd_id string, target_role_id string, job_title string, company string, seniority_band string, min_years_experience int, required_skills array<string>, preferred_skills array<string>, generated_at string"), "synthetic_jd")
    pct = lambda n, k: (20000 * n + k) // (2 * k) / 100
    want = sorted((c, f"j{j}", pct(n, len(w)), len(w) - n) for c, v in has.items() for j, w in wants.items() if role(c) == role(j) and (n := len(v & w)))
    rows, n = moved(star.match_results(spark, str(tmp_path)))
    assert sorted(map(tuple, rows)) == want
    assert n == 0, f"{n} rows moved to meet"
    runs = [k for k, _ in groupby(rows, lambda r: r[1:])]
    assert len(runs) == len({*runs})
    monkeypatch.setattr(star, "TILE", (20, 11))
    df = star.match_results(spark, str(tmp_path))
    assert df.rdd.getNumPartitions() == 5 * 4 and sorted(map(tuple, df.collect())) == want


def test_tiled(spark):
    from vocata.session import tiled

    left = spark.range(50).selectExpr("id AS a", "CASE WHEN id < 40 THEN 'hot' WHEN id < 48 THEN 'x' END AS k")
    right = spark.range(30).selectExpr("id AS b", "CASE WHEN id < 20 THEN 'hot' WHEN id < 25 THEN 'y' WHEN id < 28 THEN 'x' END AS k")
    want = sorted((r["a"], r["b"]) for r in left.join(right, "k").collect())
    for most, parts in ((99, 8 * 5), (10, 4 * 3)):
        df = tiled(left, right, "k", ("a", "b"), (50, 30), (7, 6), most)
        assert df.rdd.getNumPartitions() == parts
        assert sorted((x["a"], y["b"]) for r in df.collect() for x in r["l"] for y in r["r"]) == want
    assert not tiled(left, right.filter("k = 'y'"), "k", ("a", "b"), (50, 0), (7, 6)).collect()


def test_match_tfidf_moves_no_pairs(spark, tmp_path):
    """Every resume shares term s1 with every posting of its role."""
    import math

    from vocata.operators.similarity import tfidf_cosine

    cv = {f"c{c}": sorted({"s1", f"s{c % 40}", f"s{c % 7 + 40}"}) for c in range(300)}
    ad = {f"j{j}": sorted({"s1", *(f"s{x}" for x in range(j, j + 3))}) for j in range(45)} | {"j0": ["s1"]}
    role = lambda k: {"c7": "other", "c8": None, "j9": None}.get(k, "r")
    write = lambda rows, kinds, n: spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/{n}.parquet")
    write([(k, role(k), v, "n", "2020") for k, v in cv.items()], "resume_id string, target_role_id string, skills array<string>, name string, generated_at string", "synthetic_resume")
    write([(k, role(k), "t", "c", "b", 1, v, [], "2020") for k, v in ad.items()] + [("empty", "r", "t", "c", "b", 1, [], ["s1"], "2020")], "jd_id string, target_role_id string, job_title string, company string, seniority_band string, min_years_experience int, required_skills array<string>, preferred_skills array<string>, generated_at string", "synthetic_jd")
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    usual = spark.conf.get(threshold)
    spark.conf.set(threshold, -1)
    try:
        rows, n = moved(pipeline.match_tfidf(spark, str(tmp_path)))
    finally:
        spark.conf.set(threshold, usual)
    got = {r["resume_id"]: (r["best_cosine"], r["n_jobs"]) for r in rows}
    df = {t: sum(t in v for v in [*cv.values(), *ad.values()]) for v in [*cv.values(), *ad.values()] for t in v}
    w2 = {t: math.log(1 + 345 / k) ** 2 for t, k in df.items()}
    dot = lambda a, b: sum(w2[t] for t in {*a} & {*b})
    best = {k: max(dot(v, x) / math.sqrt(dot(v, v) * dot(x, x)) for j, x in ad.items() if role(j) == "r") for k, v in cv.items() if role(k) == "r"}
    assert {k: v[1] for k, v in got.items()} == dict.fromkeys(best, 44) and all(abs(got[k][0] - v) < 1e-6 for k, v in best.items())
    assert n < 300 * 44 / 4, f"{n} rows moved"
    side = lambda d: spark.createDataFrame([(k, role(k), t) for k, v in d.items() for t in v], "id string, role_id string, term string")
    pairs = tfidf_cosine(side(cv), side(ad)).groupBy("left_id").agg(F.max("cosine"), F.count("*")).collect()
    assert got == {r[0]: (r[1], r[2]) for r in pairs}


def test_tfidf_scores_by_parts(monkeypatch):
    """Parts of the right side, long rows and many near equal scores give what a plain sum gives."""
    import numpy as np
    import pyarrow as pa

    from vocata.operators import similarity as s

    rng = np.random.default_rng(7)
    w2 = rng.uniform(0.5, 90, 6000)
    draw = lambda n, top, most: [np.sort(rng.choice(top, rng.integers(1, most), replace=False)) for _ in range(n)]
    left, right = draw(150, 40, 9) + [np.arange(5990, 6000)], draw(400, 30, 7) + [np.arange(20, 5000)]
    table = lambda rows: pa.table({"id": [*range(len(rows))], "t": [r.tolist() for r in rows], "w2": [w2[r].tolist() for r in rows]})
    want = {}
    for i, a in enumerate(left):
        dots = np.array([w2[np.intersect1d(a, b)].sum() for b in right])
        if dots.any():
            want[i] = (round((dots / np.sqrt(w2[a].sum() * np.array([w2[b].sum() for b in right]))).max(), 9), np.count_nonzero(dots))
    for cells in (1 << 24, 500):
        monkeypatch.setattr(s, "CELLS", cells)
        got = s._best(table(left), table(right)).to_pylist()
        assert {r["id"]: (round(r["best"], 9), r["n"]) for r in got} == want
    assert not s._best(table(left).slice(0, 0), table(right)).num_rows and not s._best(table(left), table(right).slice(0, 0)).num_rows
