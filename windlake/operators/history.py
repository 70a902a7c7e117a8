"""Row order within stations, by chunks of time: what a window over a whole station gives, without a task that holds one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hours of a chunk where a job asks for chunks: ten years, some 88,000 hourly rows.
CHUNK_HOURS = 87_600


def chunk_of(ts: str, hours: int) -> Column:
    """The number of a time's chunk; rows without a time are a chunk of their own, before all others."""
    return F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(hours * 3_600_000_000))


def with_halo(df: DataFrame, cols: Sequence[str], rows: int, station: str, ts: str, hours: int, parts: int | None = None) -> DataFrame:
    """df with _chunk and _halo: every row, and before each chunk of a station the last ``rows`` rows of the chunks before it, as
    rows with _halo true that have the station, the time and ``cols`` only.

    A window over (station, _chunk) then sees what it needs of the past, whatever gaps there are. The last rows of each
    chunk are handed on through a table of a row for each station and chunk. With ``parts`` rows are dealt by station and chunk
    into so many partitions, for a number that grows with the rows, so that a task's memory doesn't.
    """
    deal = lambda d: d.repartition(parts, station, "_chunk") if parts else d
    d = df.withColumns({"_chunk": chunk_of(ts, hours), "_halo": F.lit(False)})
    late = Window.partitionBy(station, "_chunk").orderBy(F.desc_nulls_last(ts))
    last = deal(d.select(station, "_chunk", ts, *cols)).select("*", F.row_number().over(late).alias("_nth")).where(F.col("_nth") <= rows)
    tails = last.groupBy(station, "_chunk").agg(F.sort_array(F.collect_list(F.struct(-F.col("_nth"), F.col(ts).alias("t"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(cols))))).alias("tail"))
    before = Window.partitionBy(station).orderBy("_chunk").rowsBetween(-rows, -1)
    past = F.flatten(F.collect_list("tail").over(before))
    tails = tails.select(station, "_chunk", past.alias("past"))
    tails = tails.select(station, "_chunk", F.explode(F.slice("past", F.greatest(F.size("past") - rows + 1, F.lit(1)), rows)).alias("x"))
    kinds = dict(d.dtypes)
    given = {station: F.col(station), ts: F.col("x.t"), "_chunk": F.col("_chunk"), "_halo": F.lit(True)} | {c: F.col(f"x.c{i}") for i, c in enumerate(cols)}
    halo = tails.select(*(given.get(c, F.lit(None).cast(kinds[c])).alias(c) for c in d.columns))
    return deal(d.unionByName(halo))


def chunk_order(station: str, ts: str) -> Window:
    """The order of a chunk's rows, those handed on first (a time may be NULL there too)."""
    return Window.partitionBy(station, "_chunk").orderBy(F.desc("_halo"), ts)
