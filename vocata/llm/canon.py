"""Mapping freely typed values to a canonical list.

Token-level repair: each distinct token of the typed values is joined to the vocabulary of
the reference entries by edit distance. The join is an equi-join on pigeonhole keys: a
vocabulary token is cut into three segments, and within two edits one of them stands
unchanged in the typed token, shifted by two places at most, or as a swap with the next
segment's letter leaves it. The corrected tokens are then
combined by soft TF-IDF, which ranks whole entries.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, parallelism, small

# Letters of other scripts, accents and digits that stand for a Latin letter.
LOOKALIKES = (
    "авеѕікмнорстухјԁαβεηικμνορτυχàáâãäåçèéêëìíîïñòóôõöøùúûüýÿ",
    "abesikmhopctyxjdabenikmvoptuxaaaaaaceeeeiiiinoooooouuuuyy",
)
#: Weight of a typed token that resembles no vocabulary token, beside idf weights of about 3 to 6.
UNKNOWN_WEIGHT = 0.8


def normal(text: Column) -> Column:
    """Lower case with look-alike letters replaced by their Latin ones."""
    return F.translate(F.lower(text), *LOOKALIKES)


def _tokens(text: Column) -> Column:
    """Runs of letters and digits, each with the full stop right behind it."""
    return F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+[.]?)"), F.lit(1))


def reference_entries(names: DataFrame, name: str, target: str) -> DataFrame:
    """``(entry, target, token)``: the tokens of each reference name, and the name written as one word.

    Null or wordless names are left out; the same name for the same target is one entry.
    """
    rows = names.select(normal(F.col(name)).alias("_norm"), F.col(target).alias("target")).dropna()
    rows = rows.withColumn("_t", F.transform(_tokens(F.col("_norm")), lambda x: F.rtrim(x, F.lit(".")))).filter("size(_t) > 0")
    rows = rows.select("target", F.array_distinct("_t").alias("_t"), F.concat_ws("", "_t").alias("_glued")).distinct()
    many = rows.select("target", F.col("_t").alias("tokens"))
    glued = rows.filter("size(_t) > 1").select("target", F.array("_glued").alias("tokens"))
    both = many.unionByName(glued).distinct()
    return both.select(F.xxhash64("target", F.concat_ws(" ", "tokens")).alias("entry"), "target", F.explode("tokens").alias("token"))


def _vocabulary_keys(vocab: DataFrame) -> DataFrame:
    n = F.length("vtoken")
    cut = lambda i: F.floor(n * i / 3).cast("int")
    segs = [F.concat(n.cast("string"), F.lit(f":{i}:"), F.col("vtoken").substr(cut(i) + 1, cut(i + 1) - cut(i))) for i in range(3)]
    at = lambda p: F.col("vtoken").substr(p, F.lit(1))
    for i in range(3):  # a swap across a border breaks two segments at once: they also stand as it leaves them
        first, last, head = cut(i) + 1, cut(i + 1), F.concat(n.cast("string"), F.lit(f":{i}:"))
        if i > 0:
            segs.append(F.concat(head, at(first - 1), F.col("vtoken").substr(first + 1, last - first)))
        if i < 2:
            segs.append(F.concat(head, F.col("vtoken").substr(first, last - first), at(last + 1)))
    heads = F.when(n >= 7, F.array(F.concat(F.lit("p:"), F.substring("vtoken", 1, 5)))).otherwise(F.array().cast("array<string>"))
    short = F.transform(F.sequence(F.lit(3), F.greatest(F.lit(3), F.least(n - 1, F.lit(7)))), lambda k: F.concat(F.lit("a:"), F.col("vtoken").substr(F.lit(1), k)))
    keys = F.concat(F.array(F.concat(F.lit("=:"), F.col("vtoken"))), F.when(n >= 4, F.array(*segs)).otherwise(F.array().cast("array<string>")), heads, short)
    return vocab.select("vtoken", F.explode(F.array_distinct(keys)).alias("key"))


def _keys_of(token: str, dotted: bool) -> list[str]:
    """Keys under which a typed token meets the vocabulary.

    A segment that two edits leave whole is shifted by the letters put in less those taken
    out before it; with those behind it that makes two at most, so |s| + |d - s| <= 2 for the
    shift s and the difference in length d.
    """
    n, keys = len(token), ["=:" + token]
    if n >= 4:
        for size in range(max(4, n - 2), n + 3):
            cuts = [size * i // 3 for i in range(4)]
            for s in range(-2, 3):
                if abs(s) + abs(n - size - s) <= 2:
                    keys += [f"{size}:{i}:{token[a + s : b + s]}" for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if a + s >= 0 and b + s <= n]
    if n >= 7:
        keys.append("p:" + token[:5])
    if dotted and n >= 3:
        keys.append("a:" + token)
    return list(dict.fromkeys(keys))


def _typed_keys(tokens: DataFrame) -> DataFrame:
    keys = F.pandas_udf(lambda t, d: pd.Series([_keys_of(x, y) for x, y in zip(t, d)], dtype=object), "array<string>")
    return tokens.select("token", "dotted", F.explode(keys("token", "dotted")).alias("key"))


def edit_distance(left: Sequence[str], right: Sequence[str]) -> np.ndarray:
    """Edits between each two words, a swap of neighbours counted as one; all pairs of a batch at once, row by row of the table."""
    n = len(left)
    la, lb = (np.fromiter(map(len, x), np.int64, n) for x in (left, right))
    x, y = (np.array(w, dtype=f"U{max(1, m.max(initial=1))}").view(np.uint32).reshape(n, -1) for w, m in ((left, la), (right, lb)))
    step = np.arange(y.shape[1] + 1, dtype=np.int16)
    last, row = None, np.tile(step, (n, 1))
    out = np.where(la == 0, lb, 0).astype(np.int16)
    for i in range(x.shape[1]):
        best = np.empty_like(row)
        best[:, 0] = i + 1
        best[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + (x[:, i : i + 1] != y))
        if i:
            swap = (x[:, i : i + 1] == y[:, :-1]) & (x[:, i - 1 : i] == y[:, 1:])
            best[:, 2:] = np.where(swap, np.minimum(best[:, 2:], last[:, :-2] + 1), best[:, 2:])
        last, row = row, np.minimum.accumulate(best - step, axis=1) + step  # letters put in, as a running minimum
        done = la == i + 1
        out[done] = row[done, lb[done]]
    return out


def _similar(floor: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            a, b = (pdf[c].str.len().to_numpy() for c in ("token", "vtoken"))
            order = np.argsort(np.maximum(a, b), kind="stable")
            sim = np.zeros(len(pdf))
            token, vtoken = pdf["token"].to_numpy(), pdf["vtoken"].to_numpy()
            for at in range(0, len(pdf), 2000):  # words of like length together, so that little is padded
                part = order[at : at + 2000]
                sim[part] = 1 - edit_distance(list(token[part]), list(vtoken[part])) / np.maximum(a[part], b[part])
            strict = (np.minimum(a, b) <= 3) | pdf["vtoken"].str.contains(r"[0-9]$").to_numpy()
            sim[strict & (token != vtoken)] = 0.0
            begins = np.fromiter((d and n >= 3 and v.startswith(t) for d, n, t, v in zip(pdf["dotted"], a, token, vtoken)), bool, len(pdf))
            sim = np.maximum(sim, np.where(begins, 0.9, 0.0))
            yield pdf.assign(sim=sim)[sim >= floor]

    return run


def repair_tokens(tokens: DataFrame, vocab: DataFrame, floor: float = 0.55) -> DataFrame:
    """``(token, dotted, vtoken, sim)``: the vocabulary tokens that each distinct typed token may mean.

    ``sim`` is 1 - distance / longer length, where a swap of neighbours is one edit; tokens
    of three letters or fewer and codes that end with a digit allow no edit. A token with a
    full stop also means every word it begins, at 0.9. All pairs within two edits are found.
    """
    a, b = F.length("token"), F.length("vtoken")
    # no number of edits makes up for a difference in length above what the floor allows
    near = (F.abs(a - b) <= (1 - floor) * F.greatest(a, b)) | (F.col("dotted") & F.startswith("vtoken", F.col("token")))
    pairs = _typed_keys(tokens).join(small(_vocabulary_keys(vocab)), "key").select("token", "dotted", "vtoken").filter(near).distinct()
    return pairs.mapInPandas(_similar(floor), "token string, dotted boolean, vtoken string, sim double")


def map_to_canonical(values: DataFrame, value: str, entries: DataFrame, coverage: float = 0.8, cosine: float = 0.6, single: float = 0.8) -> DataFrame:
    """``(value, target, score)``: the entry that each distinct non-null value means, or a null target.

    An entry qualifies if the corrected tokens cover at least ``coverage`` of its squared
    idf weight (``single`` for entries of one word) and the soft TF-IDF cosine reaches
    ``cosine``. A value of two or more words, all of which belong to an entry, also means it
    if no other target has them all. The best by cosine, then by coverage, then the smallest target wins, so ties
    have one result. Blank, wordless and unmatched values, and any value against an empty
    list, have a null target. Values may repeat; each is mapped once.
    """
    typed = cut(values.select(F.col(value).alias("value")).filter("value IS NOT NULL").distinct())
    entries = cut(entries)
    n = entries.select("entry").distinct().count()
    vocab = cut(entries.groupBy("token").agg(F.countDistinct("entry").alias("df")).select(F.col("token").alias("vtoken"), F.log(1 + n / F.col("df")).alias("w")))
    weighted = entries.join(small(vocab), F.col("token") == F.col("vtoken")).drop("token")
    size = weighted.groupBy("entry").agg(F.sum(F.pow("w", F.lit(2))).alias("e2"), F.count("*").alias("e_words"))
    weighted = cut(weighted.join(size, "entry"))
    # each word as typed, each two neighbours as one word (a space too many), and all as one
    spelt = typed.select("value", _tokens(normal(F.col("value"))).alias("t"))
    bare = F.transform("t", lambda x: F.rtrim(x, F.lit(".")))
    many = F.size("t")
    two = F.transform(F.sequence(F.lit(1), many - 1), lambda i: F.concat(F.element_at("b", i), F.element_at("b", i + 1)))
    none = F.array().cast("array<string>")
    glued = F.concat(F.when(many >= 2, two).otherwise(none), F.when(many >= 3, F.array(F.concat_ws("", "b"))).otherwise(none))
    spelt = spelt.withColumn("b", bare).select(
        "value", F.concat(F.transform("t", lambda x: F.struct(F.rtrim(x, F.lit(".")).alias("token"), F.endswith(x, F.lit(".")).alias("dotted"), F.lit(False).alias("glued"))), F.transform(glued, lambda x: F.struct(x.alias("token"), F.lit(False).alias("dotted"), F.lit(True).alias("glued")))).alias("w")
    ).select("value", F.explode("w").alias("w")).select("value", "w.*")
    spelt = cut(spelt)  # read twice: for the distinct tokens and for what each value is made of
    # few bytes but much work for each token: spread them over all tasks, whatever their size
    tokens = spelt.select("token", "dotted").distinct().repartition(parallelism(typed))
    repaired = repair_tokens(tokens, vocab.select("vtoken")).join(small(vocab), "vtoken")
    best = repaired.groupBy("token", "dotted").agg(F.collect_list(F.struct("vtoken", "sim")).alias("cands"), F.max_by("w", F.struct("sim", "w")).alias("wq"))
    best = cut(best)  # vocabulary tokens near one token are at most the reference vocabulary
    known = spelt.join(small(best), ["token", "dotted"], "left")
    # what the typed words weigh; two words glued count only through what they match
    weight = F.when(F.col("glued"), F.lit(0.0)).otherwise(F.pow(F.coalesce("wq", F.lit(UNKNOWN_WEIGHT)), F.lit(2)))
    per_value = known.groupBy("value").agg(
        F.sum(weight).alias("q2"), F.flatten(F.collect_list("cands")).alias("cands"), F.count_if(~F.col("glued") & F.col("wq").isNull()).alias("strange"), F.count_if(~F.col("glued")).alias("q_words")
    )
    hits = per_value.select("value", "q2", "strange", "q_words", F.explode("cands").alias("c")).groupBy("value", "q2", "strange", "q_words", "c.vtoken").agg(F.max("c.sim").alias("sim"))
    scored = (
        hits.join(small(weighted), "vtoken")
        .groupBy("value", "q2", "strange", "q_words", "entry", "target", "e2", "e_words")
        .agg(F.sum(F.col("sim") * F.pow("w", F.lit(2))).alias("dot"), F.count("*").alias("met"))
        .withColumn("cover", F.col("dot") / F.col("e2"))
        .withColumn("score", F.least(F.lit(1.0), F.col("dot") / F.sqrt(F.col("e2") * F.greatest("q2", "dot"))))
    )
    whole = (F.col("cover") >= F.when(F.col("e_words") == 1, single).otherwise(coverage)) & (F.col("score") >= cosine)
    part = (F.col("strange") == 0) & (F.col("q_words") >= 2) & (F.col("met") == F.col("q_words")) & (F.col("dot") >= 0.95 * F.col("q2"))
    scored = scored.filter(whole | part).withColumn("part", ~whole)
    chosen = scored.groupBy("value").agg(
        F.min_by(F.struct("target", "score", "part"), F.struct("part", -F.round("score", 9), -F.round("cover", 9), "target")).alias("b"),
        F.count_distinct("target").alias("meant"),
    )
    chosen = chosen.filter("NOT b.part OR meant = 1").select("value", "b.target", "b.score")
    return typed.join(chosen, "value", "left")
