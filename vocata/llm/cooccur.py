"""Items that appear together: stripes and log-likelihood ratios.

Each map task keeps, for every item, an associative array of its neighbours and their
counts, and emits those stripes instead of the pairs of each record. Stripes are merged by
key: the element-wise sum runs as a hash aggregate on (item, neighbour) with partial
aggregation, so the stripe of an item that a third of the records hold is spread over all
tasks and no array of unbounded length meets in one. The entry of an item for itself is
the number of records with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, small

#: Distinct (item, neighbour) entries that a task holds before it emits its stripes.
HELD = 2_000_000
_STRIPE = "item string, neighbours array<string>, counts array<bigint>"


def latest_baskets(df: DataFrame, record: str, items: str, version: str) -> DataFrame:
    """One basket per record: its row of the latest version, items trimmed, lower-cased, distinct.

    Null and blank items are dropped; a null or empty array is an empty basket, which still
    counts as a record. A null version is older than any other. Among rows of one version
    that differ, the one with the greatest items wins, so the result does not depend on
    row order. Rows with a null record id are left out.
    """
    given = F.coalesce(F.col(items), F.array().cast("array<string>"))
    clean = F.filter(F.array_distinct(F.transform(given, lambda x: F.lower(F.regexp_replace(x, r"^\s+|\s+$", "")))), lambda x: x.isNotNull() & (x != ""))
    rows = df.filter(F.col(record).isNotNull()).select(F.col(record).alias("record"), clean.alias("items"), F.col(version).alias("v"))
    return rows.groupBy("record").agg(F.max_by("items", F.struct("v", F.to_json("items"))).alias("items"))


def _stripes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names: list[str] = []
    code: dict[str, int] = {}
    keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    waiting: list[np.ndarray] = []  # pairs not yet counted in, at most about HELD

    def emit(keys: np.ndarray, counts: np.ndarray) -> pd.DataFrame:
        a, b = keys >> 32, keys & 0xFFFFFFFF
        at = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.empty(0, np.int64)
        ends = np.r_[at[1:], len(a)]
        word = np.array(names, dtype=object)
        return pd.DataFrame({"item": word[a[at]], "neighbours": [word[b[i:j]] for i, j in zip(at, ends)], "counts": [counts[i:j] for i, j in zip(at, ends)]})

    for pdf in batches:
        by_size: dict[int, list[np.ndarray]] = {}
        for basket in pdf["items"]:
            if basket is not None and len(basket):
                row = np.fromiter((code.setdefault(x, len(code)) for x in basket), np.int64, len(basket))
                row.sort()
                by_size.setdefault(len(row), []).append(row)
        names.extend(list(code)[len(names):])
        for k, rows in by_size.items():
            m = np.stack(rows)
            for i in range(k):  # one item against the rest of its basket at a time: k^2 is never held
                waiting.append(((m[:, i : i + 1] << 32) | m[:, i:]).ravel())
                if sum(map(len, waiting)) > HELD:
                    keys, counts = _merge(keys, counts, waiting)
                    waiting = []
                    if len(keys) > HELD:
                        yield emit(keys, counts)
                        keys, counts = keys[:0], counts[:0]
    keys, counts = _merge(keys, counts, waiting)
    if len(keys):
        yield emit(keys, counts)


def _merge(keys: np.ndarray, counts: np.ndarray, waiting: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, at = np.unique(np.concatenate([keys, *waiting]), return_inverse=True)
    return key, np.bincount(at, np.concatenate([counts, *(np.ones(len(w)) for w in waiting)]), len(key)).astype(np.int64)


def llr(n_ab, n_a, n_b, n):
    """Log-likelihood ratio G2 of the 2x2 table of two items, as a column."""

    def h(*xs):
        return sum(F.when(x > 0, x * F.log(x / n)).otherwise(0.0) for x in xs)

    d = lambda x: x.cast("double")
    ab, a, b, n = d(n_ab), d(n_a), d(n_b), d(n)
    return F.greatest(F.lit(0.0), 2 * (h(ab, a - ab, b - ab, n - a - b + ab) - h(a, n - a) - h(b, n - b)))


#: Chi-square quantile of one degree of freedom at 5 %.
SIGNIFICANT = 3.84


def cooccurrence(baskets: DataFrame) -> DataFrame:
    """``(item_a, item_b, n_ab, n_a, n_b, n_records, lift, llr)`` of all pairs with item_a < item_b.

    ``baskets`` is ``(record, items array<string>)`` with distinct items, as
    :func:`latest_baskets` makes it. No pair is dropped; an empty table gives no rows. What
    a task emits are stripes, but they are merged element by element (see above), as an
    array per item would grow with the vocabulary.
    """
    stripes = baskets.select("items").mapInPandas(_stripes, _STRIPE)
    entry = stripes.select("item", F.explode(F.arrays_zip("neighbours", "counts")).alias("e")).select(
        F.least("item", "e.neighbours").alias("item_a"), F.greatest("item", "e.neighbours").alias("item_b"), F.col("e.counts").alias("n")
    )
    merged = cut(entry.groupBy("item_a", "item_b").agg(F.sum("n").alias("n_ab")))
    n_records = baskets.count()  # reads the record ids alone
    single = merged.filter("item_a = item_b").select(F.col("item_a").alias("item"), F.col("n_ab").alias("n_item"))
    single = small(single)
    return (
        merged.filter("item_a < item_b")
        .join(single.withColumnsRenamed({"item": "item_a", "n_item": "n_a"}), "item_a")
        .join(single.withColumnsRenamed({"item": "item_b", "n_item": "n_b"}), "item_b")
        .withColumn("n_records", F.lit(n_records))
        .withColumn("lift", F.col("n_ab") * F.col("n_records") / (F.col("n_a") * F.col("n_b")))
        .withColumn("llr", llr(F.col("n_ab"), F.col("n_a"), F.col("n_b"), F.col("n_records")))
    )
