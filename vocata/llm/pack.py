"""Filling containers of fixed capacity by the sum-of-squares rule.

Documents are hashed into groups of a fixed number of tokens, so a group always fits one
task, however large the corpus. Within a group, documents come in order of size, the
largest first, and each goes where the sum over residual gaps of the squared number of
open containers with that gap becomes smallest; a group leaves a container or two not
full, a share that the group size bounds.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .tokens import TOKENIZER_DIR, VOCABULARY, token_count

#: Containers that one group fills, about; the waste left at the end of a group is spread over these.
GROUP_CONTAINERS = 1000


def sum_of_squares(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container index of each item (every size between 1 and ``capacity``), in the order given.

    With N(g) open containers of gap g, an item of size s put into a gap g changes the sum
    of squares by 2 (N(g - s) - N(g)) + 2, or 1 - 2 N(g) if it fills the container. The
    least change wins, among equals the smallest gap; a new container counts as gap
    ``capacity`` with N = 0.
    """
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    n = np.zeros(capacity + 1, np.int64)
    out = np.empty(len(sizes), np.int64)
    used = 0
    for i, s in enumerate(sizes):
        s = int(s)
        have = n[s:]
        change = 2 * (n[: capacity + 1 - s] - have) + 2
        change[0] = 1 - 2 * have[0]
        change = np.where(have > 0, change, np.iinfo(np.int64).max)
        change[-1] = 2 * n[capacity - s] + 1 if s < capacity else 0
        gap = s + int(np.argmin(change))
        if gap == capacity:
            box, used = used, used + 1
        else:
            box = open_at[gap].pop()
            n[gap] -= 1
        out[i] = box
        if gap > s:
            open_at[gap - s].append(box)
            n[gap - s] += 1
    return out


def pack(items: DataFrame, item: str, size: str, capacity: int, group_containers: int = GROUP_CONTAINERS) -> DataFrame:
    """``(item, part, size, container_id, container_fill)`` of every distinct item.

    ``container_id`` is ``group:number``. An item above the capacity is divided into full
    parts, each alone in its container, and a rest that is packed like an item; no other
    item is divided. Items of size 0 or null size 0 go with the first container of their
    group. Among rows of one item the greatest size counts; null items are left out.
    """
    rows = items.select(F.col(item).alias("item"), F.coalesce(F.col(size).cast("long"), F.lit(0).cast("long")).alias("size")).filter("item IS NOT NULL").groupBy("item").agg(F.max("size").alias("size"))
    rows = cut(rows)
    total = rows.agg(F.sum("size").alias("t")).first()["t"] or 0
    groups = max(1, -(-total // (capacity * group_containers)))
    whole = F.floor((F.col("size") - 1) / capacity).cast("int")  # full parts before the last one
    parts = rows.withColumn("whole", F.greatest(whole, F.lit(0))).select(
        "item", F.explode(F.sequence(F.lit(0), F.col("whole"))).alias("part"), F.col("size").alias("all"), "whole"
    )
    parts = parts.select("item", "part", F.when(F.col("part") < F.col("whole"), capacity).otherwise(F.col("all") - F.col("whole") * capacity).cast("long").alias("size"))
    full = parts.filter(F.col("size") == capacity).select("item", "part", "size", F.concat(F.lit("full:"), F.col("item").cast("string"), F.lit(":"), F.col("part")).alias("container_id"), F.col("size").alias("container_fill"))
    rest = parts.filter(F.col("size") < capacity).withColumn("group", F.pmod(F.xxhash64("item"), F.lit(groups)))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "item"], ascending=[False, True], ignore_index=True)
        sizes = pdf["size"].to_numpy()
        box = np.zeros(len(pdf), np.int64)
        box[sizes > 0] = sum_of_squares(sizes[sizes > 0], capacity)
        fill = np.bincount(box, sizes).astype(np.int64)
        name = f"{pdf['group'].iloc[0]}:"
        return pd.DataFrame({"item": pdf["item"], "part": pdf["part"], "size": sizes, "container_id": [name + str(b) for b in box], "container_fill": fill[box]})

    kind = dict(items.select(F.col(item).alias("item")).dtypes)["item"]
    packed = rest.groupBy("group").applyInPandas(fill, f"item {kind}, part int, size bigint, container_id string, container_fill bigint")
    return packed.unionByName(full)


def pack_texts(docs: DataFrame, doc_id: str, text: str, capacity: int, folder: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> DataFrame:
    """:func:`pack` of texts by their tokens; null and empty texts have size 0."""
    sized = docs.select(F.col(doc_id).alias("item"), token_count(F.col(text), folder, vocabulary).alias("size"))
    return pack(sized, "item", "size", capacity)


def containers(packed: DataFrame, capacity: int) -> DataFrame:
    """``(container_id, n_items, fill, unused)`` of each container that :func:`pack` filled."""
    return packed.groupBy("container_id").agg(F.count("*").alias("n_items"), F.sum("size").alias("fill")).withColumn("unused", F.lit(capacity) - F.col("fill"))
