"""References to records that do not exist.

A reference is a tuple of columns that names a record of another table by its key. The
tuple may be composite and partly null. References are grouped by their null mask, and each
mask meets the target on its non-null columns only (one join for all masks, of which the
references without a match are kept); the declared match semantics decide what a null means:

``simple``   a reference with any null is not checked (the SQL default);
``partial``  the non-null columns must agree with at least one target, all null passes;
``full``     all columns null passes, a mixture of null and non-null is itself an orphan.

A target *exists* for a reference if some row of it agrees on the compared columns, was
not removed since it was last written, and was first written no later than the reference.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import BROADCAST_ROWS, small

ABSENT, REMOVED, LATER, MIXED = "absent", "removed", "later", "mixed_nulls"


def target_state(
    targets: DataFrame,
    key: Sequence[str],
    written: str | None = None,
    removals: DataFrame | None = None,
    removal_key: Sequence[str] = (),
    removed: str | None = None,
) -> DataFrame:
    """One row per distinct target key: ``k0..kn, _first, _alive``.

    Keys with a null column name no record and are left out. A key is alive unless an
    entry of ``removals`` for it is not before its last write; with a null last write any
    entry counts. Repeated entries and entries for unknown keys change nothing.
    """
    names = [f"k{i}" for i in range(len(key))]
    at = F.col(written) if written else F.lit(None).cast("timestamp")
    rows = targets.select(*[F.col(k).alias(n) for k, n in zip(key, names, strict=True)], at.alias("_at")).dropna(subset=names)
    state = rows.groupBy(*names).agg(F.min("_at").alias("_first"), F.max("_at").alias("_last"))
    if removals is None:
        return state.select(*names, "_first", F.lit(True).alias("_alive"))
    gone = (
        removals.select(*[F.col(k).alias(n) for k, n in zip(removal_key, names, strict=True)], F.col(removed).alias("_gone"))
        .dropna(subset=[*names, "_gone"])
        .groupBy(*names)
        .agg(F.max("_gone").alias("_gone"))
    )
    alive = F.col("_gone").isNull() | F.coalesce(F.col("_gone") < F.col("_last"), F.lit(False))
    return state.join(small(gone), names, "left").select(*names, "_first", alive.alias("_alive"))


def _meet(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    """Join on columns that may be null on both sides; of ``right`` only what ``left`` lacks is kept."""
    cond = reduce(lambda a, b: a & b, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in on])
    both = left.alias("l").join(right.alias("r"), cond, how)
    return both if how in ("left_anti", "left_semi") else both.select("l.*", *[f"r.{c}" for c in right.columns if c not in on])


def _against(refs: DataFrame, state: DataFrame, on: list[str], hot_rows: int) -> DataFrame:
    """References without a living, early enough target, with the ``reason``: one join for all null masks.

    The references of hot keys are joined by broadcast with the states of those keys
    alone. There are at most ``rows / hot_rows`` such keys, and the hint is still given only
    after counting, so a key with a third of all rows never meets in one task.
    """
    first = F.when(F.col("_alive"), F.col("_first"))
    per = state.groupBy(*on).agg(F.max("_alive").alias("_lives"), F.min(first).alias("_since"), F.max(F.col("_alive") & F.col("_first").isNull()).alias("_undated"))
    if per.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        met = _meet(refs, F.broadcast(per), on, "left")
    else:
        hot = refs.groupBy(*on).count().filter(F.col("count") > hot_rows).select(*on)
        few = hot.limit(BROADCAST_ROWS + 1).count()
        if few == 0 or few > BROADCAST_ROWS:
            met = _meet(refs, per, on, "left")
        else:
            hot = F.broadcast(hot)
            met = _meet(_meet(refs, hot, on, "left_anti"), per, on, "left").unionByName(
                _meet(_meet(refs, hot, on, "left_semi"), F.broadcast(_meet(per, hot, on, "left_semi")), on, "left")
            )
    early = F.col("_undated") | F.col("_ref_at").isNull() | (F.col("_since") <= F.col("_ref_at"))
    orphans = met.filter(~F.coalesce(F.col("_lives") & early, F.lit(False)))
    reason = F.when(F.col("_lives").isNull(), ABSENT).when(~F.col("_lives"), REMOVED).otherwise(LATER)
    return orphans.withColumn("reason", reason).drop("_lives", "_since", "_undated")


def orphan_references(
    refs: DataFrame,
    ref_key: Sequence[str],
    row_id: str,
    state: DataFrame,
    referred: str | None = None,
    match: str = "simple",
    hot_rows: int = 1_000_000,
) -> DataFrame:
    """Distinct ``(row_id, k0..kn, null_mask, ref_at, reason)`` of references that do not hold.

    ``state`` comes from :func:`target_state` with as many key columns. Other columns of
    ``refs`` are not read, so clashing names are harmless. A null ``referred`` time can
    never be too early. A row delivered twice counts once. Empty tables: no references
    give no rows; no targets make every checked reference ``absent``.
    """
    if match not in ("simple", "partial", "full"):
        raise ValueError(f"unknown match semantics {match!r}")
    names = [f"k{i}" for i in range(len(ref_key))]
    at = F.col(referred) if referred else F.lit(None).cast("timestamp")
    base = refs.select(F.col(row_id).alias("row_id"), *[F.col(c).alias(n) for c, n in zip(ref_key, names, strict=True)], at.alias("_ref_at"))
    mask = reduce(lambda a, b: a + b, [F.when(F.col(n).isNull(), 1 << i).otherwise(0) for i, n in enumerate(names)])
    base = base.withColumn("null_mask", mask)
    every = (1 << len(names)) - 1
    masks = list(range(every)) if match == "partial" else [0]
    # a target stands once under each mask, without the columns that the mask leaves out
    masked = state.withColumn("null_mask", F.explode(F.array(*[F.lit(m) for m in masks])) if len(masks) > 1 else F.lit(0))
    masked = masked.withColumns({n: F.when(F.col("null_mask").bitwiseAND(1 << i) == 0, F.col(n)) for i, n in enumerate(names)} if len(masks) > 1 else {})
    found = _against(base.filter(F.col("null_mask").isin(masks)), masked, ["null_mask", *names], hot_rows)
    if match == "full":
        found = found.unionByName(base.filter((F.col("null_mask") > 0) & (F.col("null_mask") < every)).withColumn("reason", F.lit(MIXED)))
    return found.select("row_id", *names, "null_mask", F.col("_ref_at").alias("ref_at"), "reason").distinct()


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans per table, field, reason and month of the reference (null month: undated).

    ``orphans`` carries ``src_table, ref_field`` beside the columns of
    :func:`orphan_references`; rows and distinct missing keys are counted.
    """
    month = F.date_format("ref_at", "yyyy-MM")
    return orphans.groupBy("src_table", "ref_field", month.alias("month"), "reason").agg(
        F.countDistinct("row_id").alias("n_rows"), F.countDistinct("k0").alias("n_keys")
    )
