"""Readers of resumes, adverts, labels, manifests and taxonomies as DataFrames."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import block_kind

BLOCKS = "doc_id string, source_path string, pos int, text string, style string"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_blocks(content: bytes) -> list[tuple[str, str]]:
    """``(text, style)`` of the paragraphs of a DOCX file that are not blank."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    out = []
    for p in root.iter(f"{_W}p"):
        text = " ".join("".join(t.text or "" for t in p.iter(f"{_W}t")).split())
        style = p.find(f"{_W}pPr/{_W}pStyle")
        if text:
            out.append((text, style.get(f"{_W}val") if style is not None else ""))
    return out


def resume_blocks(spark: SparkSession, path: str, pdf: Callable[[bytes], list[tuple[str, str]]] | None = None) -> DataFrame:
    """One row per block of the DOCX (and, with a reader for them, PDF) files under ``path``, with its ``kind``.

    Files of other formats are not read. A file that cannot be parsed gives one block with
    a null text, so one bad file never stops a load.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    files = files.filter(F.lower("path").rlike(r"\.docx$" if pdf is None else r"\.(docx|pdf)$"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, content in zip(b["path"], b["content"]):
                doc = re.sub(r"\.\w+$", "", p.rsplit("/", 1)[-1])
                try:
                    blocks = (pdf if p.lower().endswith(".pdf") else docx_blocks)(bytes(content))
                except Exception:  # noqa: BLE001
                    blocks = [(None, "")]
                rows += [(doc, p, i, t, s) for i, (t, s) in enumerate(blocks)]
            yield pd.DataFrame(rows, columns=["doc_id", "source_path", "pos", "text", "style"])

    return files.mapInPandas(read, BLOCKS).withColumn("kind", block_kind(F.col("text"), F.col("style")))


def resume_format(spark: SparkSession, path: str) -> str:
    """Format of one resume file: raises ValueError for an unknown suffix, then FileNotFoundError if there is no such file."""
    suffix = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    if suffix not in ("docx", "pdf"):
        raise ValueError(f"no reader for the format of {path}")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        raise FileNotFoundError(path)
    return suffix


def job_text(spark: SparkSession, jd_id: str, text: str) -> DataFrame:
    """An advert given as text, as a row like those of :func:`job_texts`; a blank one raises ValueError."""
    if not text or not text.strip():
        raise ValueError("an advert without text")
    return spark.createDataFrame([(jd_id, "inline", text, "txt")], "jd_id string, source_path string, raw_text string, file_format string")


def job_texts(spark: SparkSession, path: str) -> DataFrame:
    """``(jd_id, source_path, raw_text, file_format)`` of the text files under ``path``."""
    df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(path, wholetext=True)
    src = F.col("_metadata.file_path")
    return df.select(F.regexp_extract(src, r"([^/]+)\.\w+$", 1).alias("jd_id"), src.alias("source_path"), F.col("value").alias("raw_text"), F.lit("txt").alias("file_format"))


def labels(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON labels, one per file; labels of another source than the generator are skipped, those without source kept."""
    df = spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(path)
    return df.filter("coalesce(source, '') IN ('', 'synthetic_generator')")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("batch string, source string, license string, count string, generated_at string, path string").option("header", "true").csv(path)


def split_statements(sql: str) -> list[str]:
    """Statements of a script: comment lines dropped, cut at a semicolon that ends a line."""
    body = "\n".join(x for x in sql.splitlines() if not x.lstrip().startswith("--"))
    return [s.strip() for s in re.split(r";[ \t]*(?:\n|$)", body) if s.strip()]


def taxonomy_nodes(spark: SparkSession, tree: dict) -> DataFrame:
    """Nodes of a parsed taxonomy tree with ids in the order of its reading and links to parents.

    The tree is a setting of a few hundred nodes, read on the driver. ``tree`` is the dict
    that a YAML or JSON reader gives.
    """
    rows: list[tuple] = []

    def add(kind: str, parent: int | None, name: str, importance: str | None, industry=None, role=None, category=None, skill=None) -> int:
        rows.append((len(rows) + 1, kind, industry, role, category, skill, name, parent, importance))
        return len(rows)

    for ind in tree.get("industries") or []:
        i = add("industry", None, ind["name"], None, ind["id"])
        for role in ind.get("roles") or []:
            r = add("role", i, role["name"], None, ind["id"], role["id"])
            for cat in role.get("categories") or []:
                c = add("category", r, cat["name"], None, ind["id"], role["id"], cat["id"])
                for sk in cat.get("skills") or []:
                    s = add("skill", c, sk["name"], sk.get("importance"), ind["id"], role["id"], cat["id"], sk["id"])
                    for sub in sk.get("sub_skills") or []:
                        add("sub_skill", s, sub, None, ind["id"], role["id"], cat["id"], sk["id"])
    return spark.createDataFrame(rows, "id long, node_type string, industry_id string, role_id string, category_id string, skill_id string, node_name string, parent_id long, importance string")
