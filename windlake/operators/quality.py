"""Data quality of stations: gaps, range, frozen sensors, jumps, repeated keys. One scan or one window for all stations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windlake.operators.history import chunk_order, with_halo


def pct(part: Column, whole: Column) -> Column:
    return F.round(part / F.greatest(whole, F.lit(1)) * 100, 3)


def missing_report(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """column, missing, missing_pct, in one pass."""
    cols = list(cols or df.columns)
    one = df.agg(F.count(F.lit(1)).alias("_n"), *(F.count_if(F.col(c).isNull()).alias(c) for c in cols))
    long = one.unpivot(["_n"], cols, "column", "missing")
    return long.select("column", "missing", pct(F.col("missing"), F.col("_n")).alias("missing_pct"))


def dataset_overview(df: DataFrame, station: str = "zone", ts: str = "ts") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(station).alias("stations"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def assert_unique(df: DataFrame, station: str = "zone", ts: str = "ts") -> None:
    """Raises if a station has two rows of one time."""
    again = repeated_keys(df, station, ts).limit(1).collect()
    if again:
        raise ValueError(f"{station} {again[0][station]} has {again[0]['n']} rows at {again[0][ts]}")


def repeated_keys(df: DataFrame, station: str = "zone", ts: str = "ts") -> DataFrame:
    return df.groupBy(station, ts).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def _finite(c: Column) -> Column:
    return F.when((F.abs(c) < float("inf")), c)


def _runs(df: DataFrame, col: str, station: str, ts: str, chunk_hours: int | None, aggs: dict[str, tuple[Column, Column]], parts: int | None = None) -> DataFrame:
    """station and one row for each maximal run of equal finite values (a missing value is a run of its own): start_ts,
    start_pos (from 0), length (finite values), value, and ``aggs``: how each is counted in a run's rows and how parts add up.
    The rows have _raw, _v and jump. By chunks, a run's parts are put together over the edges."""
    keep = [station, ts, F.col(col).alias("_raw"), _finite(F.col(col)).alias("_v")]
    d = df.select(*keep)
    if chunk_hours:
        d, order, by = with_halo(d, ["_raw", "_v"], 1, station, ts, chunk_hours, parts), chunk_order(station, ts), [station, "_chunk"]
    else:
        order, by = Window.partitionBy(station).orderBy(ts), [station]
        d = d.withColumn("_halo", F.lit(False))
    d = d.withColumns({"_starts": F.when(F.col("_v") == F.lag("_v").over(order), 0).otherwise(1), "jump": F.abs(F.col("_raw") - F.lag("_raw").over(order))})
    own = ~F.col("_halo")
    d = d.withColumns({"_run": F.sum(F.when(own, F.col("_starts")).otherwise(0)).over(order), "_pos": F.sum(own.cast("long")).over(order) - 1}).where(own)
    runs = d.groupBy(*by, "_run").agg(F.min(ts).alias("start_ts"), F.min("_pos").alias("start_pos"), F.count(F.lit(1)).alias("rows"), F.count("_v").alias("length"), F.first("_v").alias("value"), *(c.alias(n) for n, (c, _) in aggs.items()))
    if not chunk_hours:
        return runs.drop("_run")
    # run 0 of a chunk goes on from the chunk before; a chunk that is all run 0 hands on what it was handed
    chunks = runs.groupBy(station, "_chunk").agg(F.max("_run").alias("last"), F.sum("rows").alias("rows"))
    past = Window.partitionBy(station).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    owner = F.last(F.when(F.col("last") > 0, F.struct(F.col("_chunk").alias("c"), F.col("last").alias("r"))), True).over(past)
    chunks = chunks.select(F.struct(station, "_chunk").alias("_key"), owner.alias("_owner"), F.coalesce(F.sum("rows").over(past), F.lit(0)).alias("_before"))
    deal = lambda d, *by: d.repartition(parts, *by) if parts else d
    # a struct is never NULL, and its missing fields are equal
    d = deal(runs.withColumn("_key", F.struct(station, "_chunk")), "_key").join(deal(chunks, "_key"), "_key")
    goes_on = F.col("_run") == 0
    d = d.withColumns({"_at": F.when(goes_on, F.col("_owner.c")).otherwise(F.col("_chunk")), "_id": F.when(goes_on, F.col("_owner.r")).otherwise(F.col("_run")), "start_pos": F.col("start_pos") + F.col("_before")})
    total = [F.sum("rows").alias("rows"), F.sum("length").alias("length"), F.first("value", True).alias("value")]
    return deal(d, station, "_at").groupBy(station, "_at", "_id").agg(F.min("start_ts").alias("start_ts"), F.min("start_pos").alias("start_pos"), *total, *(c.alias(n) for n, (_, c) in aggs.items())).drop("_at", "_id")


def frozen_runs(df: DataFrame, col: str, min_run: int = 6, station: str = "zone", ts: str = "ts", chunk_hours: int | None = None) -> DataFrame:
    """Maximal runs of equal finite values in time order: station, start_ts, start_pos (from 0), length, value.

    A missing or infinite value ends a run. With ``chunk_hours`` no task holds more of a station than a chunk of time.
    Of rows that repeat a station and time the order is open; an empty table has no runs.
    """
    runs = _runs(df, col, station, ts, chunk_hours, {})
    return runs.where((F.col("length") >= min_run) & F.col("value").isNotNull()).select(station, "start_ts", F.col("start_pos").cast("long").alias("start_pos"), "length", "value")


def with_jump(df: DataFrame, col: str, station: str = "zone", ts: str = "ts", chunk_hours: int | None = None) -> DataFrame:
    """Adds jump (replacing a column of that name): the change since the station's row before; NULL if either is missing."""
    if not chunk_hours:
        return df.withColumn("jump", F.abs(F.col(col) - F.lag(col).over(Window.partitionBy(station).orderBy(ts))))
    d = with_halo(df, [col], 1, station, ts, chunk_hours)
    return d.withColumn("jump", F.abs(F.col(col) - F.lag(col).over(chunk_order(station, ts)))).where("not _halo").drop("_halo", "_chunk")


def jump_points(df: DataFrame, col: str, max_delta: float = 6.0, station: str = "zone", ts: str = "ts", chunk_hours: int | None = None) -> DataFrame:
    """The rows that differ from the one before by more than max_delta."""
    return with_jump(df, col, station, ts, chunk_hours).where(F.col("jump") > max_delta)


def _range(v: Column, lo: float, hi: float) -> list[Column]:
    bad = F.count_if((v < lo) | (v > hi))
    return [bad.alias("out_of_range"), pct(bad, F.count(v)).alias("out_of_range_pct")]


def _jumps(max_delta: float) -> list[Column]:
    n = F.count_if(F.col("jump") > max_delta)
    return [n.alias("jumps"), pct(n, F.count("jump")).alias("jumps_pct"), F.round(F.max("jump"), 3).alias("max_change")]


def _missing(v: Column) -> list[Column]:
    gone = F.count_if(v.isNull())
    return [F.count(F.lit(1)).alias("total"), gone.alias("missing"), pct(gone, F.count(F.lit(1))).alias("missing_pct")]


def range_check(df: DataFrame, col: str, lo: float = 0.0, hi: float = 60.0, station: str = "zone") -> DataFrame:
    """Values outside [lo, hi]; text that is no number counts as missing."""
    v = F.expr(f"try_cast(`{col}` as double)")
    return df.groupBy(station).agg(*_range(v, lo, hi))


def frozen_check(df: DataFrame, col: str, min_run: int = 6, station: str = "zone", ts: str = "ts", chunk_hours: int | None = None) -> DataFrame:
    """frozen_runs and longest_frozen of every station, 0 without any."""
    runs = frozen_runs(df, col, min_run, station, ts, chunk_hours).groupBy(station).agg(F.count(F.lit(1)).alias("r"), F.max("length").alias("l"))
    zero = lambda c, n: F.coalesce(c, F.lit(0)).cast("long").alias(n)
    return df.select(station).distinct().join(runs, station, "left").select(station, zero(F.col("r"), "frozen_runs"), zero(F.col("l"), "longest_frozen"))


def jump_check(df: DataFrame, col: str, max_delta: float = 6.0, station: str = "zone", ts: str = "ts", chunk_hours: int | None = None) -> DataFrame:
    """jumps, jumps_pct, max_change of every station."""
    return with_jump(df, col, station, ts, chunk_hours).groupBy(station).agg(*_jumps(max_delta))


def missing_summary(df: DataFrame, col: str, station: str = "zone") -> DataFrame:
    return df.groupBy(station).agg(*_missing(F.col(col)))


def station_qc_table(df: DataFrame, col: str = "ws100", lo: float = 0.0, hi: float = 60.0, min_run: int = 6, max_delta: float = 6.0, station: str = "zone", ts: str = "ts", chunk_hours: int | None = None, parts: int | None = None) -> DataFrame:
    """All four checks: one row for each station, from one sort by station and time, or by station and chunk of time (then in
    ``parts`` partitions, if given)."""
    raw, jump = F.col("_raw"), F.col("jump")
    count = lambda c, n: (c, F.sum(n))
    aggs = {
        "has": count(F.count(raw), "has"), "bad": count(F.count_if((raw < lo) | (raw > hi)), "bad"), "jumped": count(F.count_if(jump > max_delta), "jumped"),
        "gone": count(F.count_if(raw.isNull()), "gone"), "most": (F.max(jump), F.max("most")),
    }
    runs = _runs(df, col, station, ts, chunk_hours, aggs, parts)
    frozen = F.col("length") >= min_run
    return runs.groupBy(station).agg(
        F.sum("bad").alias("out_of_range"),
        pct(F.sum("bad"), F.sum("has")).alias("out_of_range_pct"),
        F.count_if(frozen).alias("frozen_runs"),
        F.coalesce(F.max(F.when(frozen, F.col("length"))), F.lit(0)).alias("longest_frozen"),
        F.sum("jumped").alias("jumps"),
        F.round(F.max("most"), 3).alias("max_change"),
        pct(F.sum("gone"), F.sum("rows")).alias("missing_pct"),
    )
