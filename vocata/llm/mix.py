"""Mixing sources to target weights by a low-discrepancy schedule.

Slot i of the schedule asks the source into whose stretch of the cumulative weights the
point frac((i + 1) * golden ratio) falls, so after any number of slots each source has its
share up to a slot or two. Slots are ranked per source, and rank r takes block r of the
source: its texts, shuffled by hash, cut into blocks of nearly equal tokens, started again
when all were used. Ranks and token positions are two-level prefix sums (within chunks,
then over chunk totals), so no source, however large, is ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut, small
from .tokens import TOKENIZER_DIR, VOCABULARY, token_count

GOLDEN = 0.6180339887498949
#: Texts or slots per chunk of a prefix sum, tokens per block, and rows of a target list at most.
CHUNK_ROWS, BLOCK_TOKENS, MAX_SOURCES = 50_000, 4096, 10_000
#: Blocks of one source at least and at most: a share is met to about a block, and the schedule has a bounded size.
MIN_BLOCKS, MAX_BLOCKS = 256, 1_000_000


def sized_texts(docs: DataFrame, doc_id: str, text: str, source: str, folder: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, source, n_tokens)`` once per document; null ids and sources are left out."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), token_count(F.col(text), folder, vocabulary).alias("n_tokens"))
    return rows.dropna(subset=["doc_id", "source"]).groupBy("doc_id").agg(F.max_by(F.struct("source", "n_tokens"), F.struct("n_tokens", "source")).alias("s")).select("doc_id", "s.*")


def mix(sized: DataFrame, targets: DataFrame, seed: int = 0, block_tokens: int = BLOCK_TOKENS) -> tuple[DataFrame, DataFrame]:
    """``(chosen, shares)`` of the largest mixture that keeps the targets and the caps, to about a block.

    chosen: ``(doc_id, source, n_tokens, repeats)``; ``repeats`` is at least 1 and at most
    the source's ``max_repeats``. shares: ``(source, target_share, aim_share, actual_share,
    tokens, available_tokens, max_repeats, note)``, a row per target and per source without
    one. A target without texts cannot be met: it is noted, and the others are scaled to
    one. The size is the least of cap x tokens / share over the sources, so a small source
    with a great share bounds the mixture. Texts of sources without target, empty texts, sources with a share of 0 or a cap
    of 0 are not used. With no usable source both results have no tokens. A repeated target
    row counts once, the greatest of differing ones.
    """
    sized = cut(sized)
    spark = sized.sparkSession
    totals = sized.groupBy("source").agg(F.sum("n_tokens").alias("have"), F.count("*").alias("docs"))
    wanted = targets.filter("source IS NOT NULL").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    plan = wanted.join(totals, "source", "left").orderBy("source").limit(MAX_SOURCES + 1).collect()
    if len(plan) > MAX_SOURCES:
        raise ValueError("a target list is a setting, not data: too many rows")
    use = [r for r in plan if (r["have"] or 0) > 0 and (r["target_share"] or 0) > 0 and (r["max_repeats"] or 0) > 0]
    share = sum(r["target_share"] for r in use)
    rows = []
    for r in use:
        blocks = min(max(MIN_BLOCKS, round(r["have"] / block_tokens)), MAX_BLOCKS)
        aim = r["target_share"] / share
        rows.append({"source": r["source"], "aim": aim, "blocks": blocks, "cap": r["max_repeats"], "have": r["have"], "chunks": max(1, -(-r["docs"] // CHUNK_ROWS))})
    weight = [r["aim"] * r["blocks"] / r["have"] for r in rows]  # slots per token aimed at
    all_w = sum(weight)
    size = min((r["cap"] * r["have"] / r["aim"] for r in rows), default=0)  # tokens of the mixture
    n = round(size * all_w)
    setting = spark.createDataFrame(
        [(r["source"], r["aim"], r["blocks"], r["cap"], r["have"], r["chunks"]) for r in rows],
        "source string, aim double, blocks long, cap int, have long, chunks long",
    )
    # texts to blocks: position of the middle of each text in the shuffled tokens of its source
    order = F.xxhash64("doc_id", F.lit(seed))
    texts = sized.filter("n_tokens > 0").join(F.broadcast(setting), "source").withColumn("h", order).withColumn("chunk", F.pmod(F.shiftrightunsigned("h", 32), F.col("chunks")))
    inner = W.partitionBy("source", "chunk").orderBy("h", "doc_id")
    texts = texts.withColumn("before", F.sum("n_tokens").over(inner) - F.col("n_tokens"))
    chunk_sum = texts.groupBy("source", "chunk").agg(F.sum("n_tokens").alias("s"))
    chunk_sum = chunk_sum.select("source", "chunk", (F.sum("s").over(W.partitionBy("source").orderBy("chunk")) - F.col("s")).alias("chunk_before"))
    middle = F.col("before") + F.col("chunk_before") + F.col("n_tokens") / 2
    texts = texts.join(small(chunk_sum), ["source", "chunk"]).withColumn("block", F.least(F.floor(middle * F.col("blocks") / F.col("have")), F.col("blocks") - 1))
    # slots to ranks
    edges, at = [], 0.0
    for w in weight:
        at += w / all_w
        edges.append(at)
    point = F.expr(f"(id + 1) * {GOLDEN}D")
    point = point - F.floor(point)
    source = F.lit(rows[-1]["source"] if rows else None).cast("string")
    for r, edge in reversed(list(zip(rows, edges))[:-1]):
        source = F.when(point < edge, r["source"]).otherwise(source)
    slots = spark.range(n).select(F.col("id").alias("slot"), source.alias("source"), F.floor(F.col("id") / CHUNK_ROWS).alias("chunk"))
    per_chunk = slots.groupBy("source", "chunk").agg(F.count("*").alias("s"))
    per_chunk = per_chunk.select("source", "chunk", (F.sum("s").over(W.partitionBy("source").orderBy("chunk")) - F.col("s")).alias("earlier"))
    rank = F.row_number().over(W.partitionBy("source", "chunk").orderBy("slot")) - 1 + F.col("earlier")
    taken = (
        slots.join(small(per_chunk), ["source", "chunk"])
        .withColumn("rank", rank)
        .join(F.broadcast(setting), "source")
        .filter(F.col("rank") < F.col("cap") * F.col("blocks"))
        .groupBy("source", F.pmod("rank", "blocks").alias("block"))
        .agg(F.count("*").alias("repeats"))
    )
    chosen = cut(texts.join(taken, ["source", "block"]).select("doc_id", "source", "n_tokens", "repeats"))
    got = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"))
    whole = got.agg(F.sum("tokens").alias("whole")).first()["whole"]
    note = F.when(F.col("target_share").isNull(), "no target").when(F.coalesce("available_tokens", F.lit(0)) == 0, "no texts").when(F.col("aim").isNull(), "not usable")
    shares = (
        wanted.join(totals.select("source", F.col("have").alias("available_tokens")), "source", "full")
        .join(setting.select("source", "aim"), "source", "left")
        .join(got, "source", "left")
        .select(
            "source", "target_share", F.col("aim").alias("aim_share"), (F.coalesce("tokens", F.lit(0)) / F.lit(whole).cast("double")).alias("actual_share"),
            F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("available_tokens", F.lit(0)).alias("available_tokens"), "max_repeats", note.alias("note"),
        )
    )
    return chosen, shares
