"""Session helpers shared by every operator: lineage cuts, checked broadcasts, table readers."""

from __future__ import annotations

import math
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side may be broadcast only when it was counted and has at most this many rows.
BROADCAST_ROWS = 100_000


def get_spark(cores: int = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings the session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("vocata")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_names(spark: SparkSession, sf_dir: str) -> list[str]:
    """Names of the Parquet tables that a data directory holds."""
    path = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return sorted(n.removesuffix(".parquet") for n in (f.getPath().getName() for f in found) if n.endswith(".parquet"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` with checkpoint() and return it with a short lineage.

    The folder is the one the cluster names in ``spark.checkpoint.dir`` (shared by the
    executors, so a lost executor loses nothing). Only a local session without that
    setting gets a temporary folder.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="vocata-")
        sc.setCheckpointDir(named)
    return df.checkpoint(eager=True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it was counted to have at most ``rows`` rows, else unchanged.

    The count stops at ``rows + 1``, so asking costs little when the side is large.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def salted_join(left: DataFrame, right: DataFrame, on: list[str], by: str, salts: int = 8) -> DataFrame:
    """Inner join whose keys are each spread over ``salts`` tasks by a hash of the column ``by`` of ``left``.

    For keys that hold a large share of the rows on the left; ``right``, the smaller side, is repeated.
    """
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)))
    every = right.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return salted.join(every, [*on, "_salt"]).drop("_salt")


def blocked(left: DataFrame, right: DataFrame, on: str, left_id: str, right_id: str, rows: int = 8192) -> tuple[DataFrame, DataFrame, int]:
    """Both sides with columns ``_a`` and ``_b``, so that two rows equal in ``on`` share one (``on``, ``_a``, ``_b``), and the number of these.

    For work on all pairs of a key that would otherwise move the pairs: a key takes as many blocks of
    about ``rows`` of each side as it holds, and a side is repeated once per block of the other.
    Rows without a key or a partner's key are left out; both sides are materialised, as they are counted first.
    """
    left, right = cut(left), cut(right)
    blocks = lambda df, name: df.groupBy(on).agg(F.ceil(F.count("*") / rows).alias(name))
    sizes = cut(blocks(left, "_na").join(blocks(right, "_nb"), on))
    n = sizes.agg(F.sum(F.col("_na") * F.col("_nb"))).first()[0] or 0
    own = lambda c, k: F.pmod(F.xxhash64(c), F.col(k))
    every = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.col(k) - 1))
    sizes = small(sizes)
    left = left.join(sizes, on).withColumn("_a", own(left_id, "_na")).withColumn("_b", every("_nb")).drop("_na", "_nb")
    right = right.join(sizes, on).withColumn("_b", own(right_id, "_nb")).withColumn("_a", every("_na")).drop("_na", "_nb")
    return left, right, n


def tiled(left: DataFrame, right: DataFrame, on: str, ids: tuple[str, str], counts: tuple[int, int], rows: tuple[int, int], most: int = 1 << 15) -> DataFrame:
    """``(on, l, r)``: for each key, blocks of both sides as arrays of structs of their other columns, so that two rows equal in ``on`` meet in one row.

    For work on all pairs of a key whose blocks should not be written once for each partner, as :func:`blocked` does.
    A side is dealt by a hash of its id into parts of about ``rows`` rows (``counts``: about how many it has), packed and
    materialised once; each task reads one part of either side, so disk grows with the sides, not with their product.
    Beyond ``most`` tasks the parts become larger.
    """
    n = [max(1, math.ceil(c / r)) for c, r in zip(counts, rows)]
    wider = max(1.0, math.sqrt(n[0] * n[1] / most))

    def packed(df: DataFrame, key: str, parts: int, name: str) -> DataFrame:
        part = F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("_part")
        blocks = df.groupBy(part, on).agg(F.collect_list(F.struct(*[c for c in df.columns if c != on])).alias(name))
        return cut(blocks.repartitionById(parts, "_part")).drop("_part")

    one, two = (packed(df, key, math.ceil(k / wider), name) for df, key, k, name in zip((left, right), ids, n, "lr"))
    return one.join(two.hint("shuffle_replicate_nl"), on)


def parallelism(df: DataFrame) -> int:
    """Number of shuffle partitions of the session."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
