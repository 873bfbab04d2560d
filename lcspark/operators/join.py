"""Joins (J1-J8).

No join here carries an unconditional broadcast hint on a side whose size
grows with the data: metadata and per-object aggregates have one row per
object, so the optimizer (and AQE at run time, from measured sizes against
``spark.sql.autoBroadcastJoinThreshold``) decides between broadcast and
shuffle.  Only constant tables (class lists) are broadcast explicitly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_metadata(obs: DataFrame, meta: DataFrame, how: str = "inner") -> DataFrame:
    """Observations with their object's metadata."""
    return obs.join(meta, "object_id", how)


def join_modifiers(obs: DataFrame, mods: DataFrame) -> DataFrame:
    """Observations with the per-object flux modifiers."""
    return obs.join(mods, "object_id", "inner")


def enrich_metadata(meta: DataFrame, mods: DataFrame, cols=("meta_val",)) -> DataFrame:
    """Metadata plus the per-object metaVal."""
    return meta.join(mods.select("object_id", *cols), "object_id", "inner")


PAD_VALUES = {"mjd": 0.0, "passband": 0, "flux": 0.0, "flux_err": 0.0, "detected": 0}


def padding_grid(objects: DataFrame, length: int, name: str = "rownum") -> DataFrame:
    """Every object x ranks 1..length, with zero pad values.  A
    generator (explode of a sequence) replaces the cross join, so there is
    no nested-loop join and no one-partition row numbering."""
    return objects.select(
        "object_id",
        F.explode(F.sequence(F.lit(1), F.lit(length))).alias(name),
    )


def grid_left_join(grid: DataFrame, ranked: DataFrame, rank_col: str = "rownum_desc",
                   grid_rank: str = "rownum", pads=None) -> DataFrame:
    """Grid left outer join the ranked observations on (object, rank);
    unmatched grid rows take the pad values."""
    pads = pads or PAD_VALUES
    right = ranked.withColumnRenamed(rank_col, grid_rank)
    joined = grid.join(right, ["object_id", grid_rank], "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in pads.items()})


def rank_join(asc: DataFrame, desc: DataFrame, rank: str = "rownum") -> DataFrame:
    """Inner join of ascending- and descending-numbered rows on
    (object, rank)."""
    return asc.join(desc, ["object_id", rank], "inner")


def join_pivot_metadata(pivot: DataFrame, meta: DataFrame, meta_cols) -> DataFrame:
    """The array (or pivot) table with metadata joined at read time."""
    return pivot.join(meta.select("object_id", *meta_cols), "object_id", "inner")


def align_pivots(pivots: dict, width: int | None = None) -> DataFrame:
    """Five wide tables (one per feature, columns <feature>1..<feature>W)
    joined on object_id and turned back into aligned long rows, dropping the
    null tail.  The unpivot is row-local (inline of an array of structs).
    Tables bucketed by object_id (``pivot_all_features``) are merged bucket
    by bucket without a shuffle.  Objects without an id are one object: their
    row of each table (pivots have one row per object) is joined by itself."""
    names = list(pivots)
    width = len(pivots[names[0]].columns) - 1 if width is None else width
    joined = none = None
    for n in names:
        p = pivots[n].where("object_id IS NOT NULL")
        joined = p if joined is None else joined.hint("merge").join(p, "object_id", "inner")
        p = pivots[n].where("object_id IS NULL")
        none = p if none is None else none.join(
            F.broadcast(p.withColumnRenamed("object_id", "_id")), F.col("object_id").eqNullSafe(F.col("_id"))).drop("_id")
    rows = F.array(*[
        F.struct(F.lit(i).alias("rownum"),
                 *[F.col(f"{n}{i}").alias(n) for n in names])
        for i in range(1, width + 1)])
    out = joined.unionByName(none).select("object_id", F.inline(rows))
    return out.filter(F.col(names[0]).isNotNull())
