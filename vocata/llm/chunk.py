"""Splitting oversized texts at natural boundaries with a fixed overlap.

Sizes are prefix sums over the tokens of a text (a token is a run of non-spaces with the
spaces after it, its size its number of code points), so the offset of every token start is
known at once. The starts that are also section, line or sentence boundaries form sorted
arrays. A piece ends at the last boundary under the limit, found by binary search, trying
sections first, then lines, sentences, token starts; a text without any of these in reach
is cut hard at the limit. The next piece starts ``overlap`` before that end.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s+|\S+\s*")
_SECTION = re.compile(r"(?:\r\n|\r|\n)[ \t]*(?:(?:\r\n|\r|\n)[ \t]*)+")
_LINE = re.compile(r"\r\n|[\r\n\x0b\x0c\x85\u2028\u2029]")
_SENTENCE = re.compile(r"[.!?…。！？]+[\"'”’)\]]*\s+|[。！？]")
KINDS = ("section", "line", "sentence", "token", "hard", "end")


def boundaries(text: str) -> list[np.ndarray]:
    """Sorted cut offsets of a text by level: sections, lines, sentences, token starts."""
    sizes = np.fromiter((len(t) for t in _TOKEN.findall(text)), np.int64)
    found = [np.fromiter((m.end() for m in p.finditer(text)), np.int64) for p in (_SECTION, _LINE, _SENTENCE)]
    return [*found, np.cumsum(sizes)]


def cut_points(text: str, max_size: int, overlap: int) -> list[tuple[int, int, str]]:
    """``(start, end, kind of boundary at the end)`` of the pieces of a text.

    A stronger boundary is taken if it leaves the piece at least half full; else the next
    level is tried, and at last any level that still makes progress past the overlap.
    """
    if not 0 <= overlap < max_size:
        raise ValueError("overlap must be at least 0 and less than the size limit")
    n, start, out = len(text), 0, []
    if n <= max_size:
        return [(0, n, "end")]
    levels = boundaries(text)

    def last(level: np.ndarray, low: int, high: int) -> int | None:
        i = int(np.searchsorted(level, high, side="right")) - 1
        return int(level[i]) if i >= 0 and level[i] > low else None

    while n - start > max_size:
        limit, end, kind = start + max_size, None, "hard"
        for low in (start + max(max_size // 2, overlap), start + overlap):
            for name, level in zip(KINDS, levels):
                if (end := last(level, low, limit)) is not None:
                    kind = name
                    break
            if end is not None:
                break
        end = end or limit
        out.append((start, end, kind))
        start = end - overlap
    out.append((start, n, "end"))
    return out


def split_oversized(
    df: DataFrame, keys: Sequence[str], text: str, max_size: int, overlap: int, only_oversized: bool = False
) -> DataFrame:
    """Pieces ``(keys..., piece_no, n_pieces, start, end, boundary, piece)`` of every text.

    Every piece has at most ``max_size`` code points; pieces overlap by exactly ``overlap``
    and cover the text, so dropping the first ``overlap`` characters of every piece but the
    first and joining them gives the text back. Null texts have no pieces; an empty text
    has one empty piece. A row delivered twice (same keys, same text) counts once. Texts
    within the limit never leave the JVM. Columns other than keys and text are not read.
    """
    rows = df.select(*keys, F.col(text).alias("_text")).filter("_text IS NOT NULL")
    long = rows.filter(F.length("_text") > max_size)
    spans = F.pandas_udf(
        lambda s: pd.Series([[{"start": a, "end": b, "boundary": k} for a, b, k in cut_points(t, max_size, overlap)] for t in s]),
        "array<struct<start:int,end:int,boundary:string>>",
    )
    # a shuffle on keys and a hash of the text, so that copies meet without sorting texts
    long = long.groupBy(*keys, F.xxhash64("_text").alias("_h")).agg(F.first("_text").alias("_text")).drop("_h")
    cut = (
        long.withColumn("_spans", spans("_text"))
        .select(*keys, "_text", F.size("_spans").alias("n_pieces"), F.posexplode("_spans").alias("piece_no", "_s"))
        .select(
            *keys, "piece_no", "n_pieces", "_s.start", "_s.end", "_s.boundary",
            F.expr("substring(_text, _s.start + 1, _s.end - _s.start)").alias("piece"),
        )
    )
    if only_oversized:
        return cut
    short = (
        rows.filter(F.length("_text") <= max_size)
        .dropDuplicates()
        .select(
            *keys, F.lit(0).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).alias("start"),
            F.length("_text").alias("end"), F.lit("end").alias("boundary"), F.col("_text").alias("piece"),
        )
    )
    return short.unionByName(cut)
