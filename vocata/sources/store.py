"""The store: creating and resetting its tables, reading one over JDBC, writing labels and texts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of the operational model in the order in which they may be filled.
SCHEMAS = {
    "skill_taxonomy": "id long, node_type string, industry_id string, role_id string, category_id string, skill_id string, node_name string, parent_id long, importance string, created_at timestamp",
    "skills": "id long, canonical_id string, canonical_name string, taxonomy_id long, is_active boolean, created_at timestamp, updated_at timestamp",
    "skill_alias": "id long, alias_text string, alias_text_norm string, skill_id long, created_at timestamp",
    "candidates": "id long, full_name string, email string, phone string, location string, target_role_id string, seniority_band string, linkedin_url string, source string, created_at timestamp, updated_at timestamp",
    "candidate_skills": "id long, candidate_id long, skill_id long, proficiency string, evidence string, source_section string, created_at timestamp, loaded_at timestamp",
    "job_skills": "job_id string, skill_id long, importance string, is_required int",
}


def create_tables(spark: SparkSession, folder: str, seed: Mapping[str, DataFrame] | None = None, reset: bool = False) -> list[str]:
    """Creates the Parquet tables that ``folder`` lacks, empty or from ``seed``; returns the names of those written.

    Running it again changes nothing; with ``reset`` every table is written anew.
    """
    written = []
    for name, schema in SCHEMAS.items():
        path = f"{folder}/{name}.parquet"
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if reset or not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            rows = (seed or {}).get(name, spark.createDataFrame([], schema))
            rows.write.mode("overwrite").parquet(path)
            written.append(name)
    return written


def jdbc_table(spark: SparkSession, url: str, name: str, column: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 8, **options: str) -> DataFrame:
    """A table of another database; with a number column and its bounds it is read in ``parts`` ranges at once."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**options)
    if column and bounds:
        reader = reader.option("partitionColumn", column).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return reader.load()


def write_labels(df: DataFrame, folder: str) -> None:
    """One JSON object a line."""
    df.write.mode("overwrite").json(folder)


def write_texts(df: DataFrame, key: str, text: str, folder: str) -> None:
    """A folder ``key=...`` per text, which a reader of whole texts finds again; null keys and texts are left out."""
    df.select(F.col(key), F.col(text).alias("value")).dropna().write.mode("overwrite").partitionBy(key).option("lineSep", "\n").text(folder)
