"""Reading and writing station-by-time tables."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from windlake.functions.physics import clean

MEASURES = {"power": "TARGETVAR", "u10": "U10", "v10": "V10", "u100": "U100", "v100": "V100"}


def parse_irregular_timestamp(text: Column | str) -> Column:
    """'20120101 1:00' to a timestamp: the date, plus the hour before the colon (24 is the next day's 0); minutes don't count."""
    s = F.trim(F.col(text) if isinstance(text, str) else text)
    hour = F.split(F.substring(s, 10, 100), ":")[0].try_cast("int")
    return F.timestamp_add("HOUR", hour, F.try_to_timestamp(F.substring(s, 1, 8), F.lit("yyyyMMdd"))).cast("timestamp_ntz")


def _headers(spark: SparkSession, paths: str | Sequence[str]) -> dict[str, str]:
    """The first line of each file, read through Spark's own file systems: of each file only its beginning."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def first_line(file: str) -> tuple[str, str]:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file))
        stream = path.getFileSystem(conf).open(path)
        try:
            return path.toString(), jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8")).readLine() or ""
        finally:
            stream.close()

    with ThreadPoolExecutor(16) as pool:
        return dict(pool.map(first_line, spark.read.text(paths).inputFiles()))


NEEDED = ["ZONEID", "TIMESTAMP", *MEASURES.values()]


def read_stations(spark: SparkSession, paths: str | Sequence[str], zones: Sequence[int] | None = None, task: int | None = None) -> DataFrame:
    """CSV files of stations as one long table: timestamp, zone, power, u10, v10, u100, v100 (and task, if given).

    Header names are trimmed and upper-cased, and files are read by name: each may spell and order its columns its own way.
    A path pattern reads whatever files there are; without any, Spark raises. A file that lacks a needed column raises, and
    names it. Missing values are NULL. Rows without a readable zone or timestamp are not in the table, but in
    ``read_stations_checked``'s second one.
    """
    good, _, bad_files = read_stations_checked(spark, paths, zones, task)
    if bad_files:
        raise ValueError("these files lack columns: " + "; ".join(f"{f} ({', '.join(lacks)})" for f, lacks in sorted(bad_files.items())))
    return good


def read_stations_checked(spark: SparkSession, paths: str | Sequence[str], zones: Sequence[int] | None = None, task: int | None = None) -> tuple[DataFrame, DataFrame, dict[str, list[str]]]:
    """The table of read_stations; a table of rejected rows (file, line, reason); and the rejected files with the columns that each
    lacks. Every line of every file but its header is in one of them. Each file is scanned once, its header apart.

    Rejected: ``columns`` (more or fewer cells than the header has), ``zone`` and ``timestamp`` (not readable). A measure that is
    no number is NULL. Empty lines are no rows.
    """
    by_header: dict[str, list[str]] = {}
    for file, header in _headers(spark, paths).items():
        by_header.setdefault(header.lstrip("\ufeff"), []).append(file)
    bad_files, parts = {}, []
    for header, files in by_header.items():  # as many as there are orders and spellings of columns
        names = [c.strip().strip('"').strip().upper() for c in header.split(",")]
        lacks = [c for c in NEEDED if c not in names]
        if lacks:
            bad_files |= dict.fromkeys(files, lacks)
            continue
        cells = [f"c{i}" for i in range(len(names))]
        schema = ", ".join(f"{c} string" for c in [*cells, "_line"])
        raw = spark.read.csv(files, schema=schema, header=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_line", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
        cell = {n: F.col(c) for n, c in zip(reversed(names), reversed(cells))}
        parts.append(
            raw.select(
                parse_irregular_timestamp(cell["TIMESTAMP"]).alias("timestamp"),
                F.expr(f"try_cast({cells[names.index('ZONEID')]} as int)").alias("zone"),
                *(clean(F.expr(f"try_cast({cells[names.index(c)]} as double)")).alias(n) for n, c in MEASURES.items()),
                F.concat_ws(",", *(F.coalesce(c, F.lit("")) for c in cells)).alias("line"),
                F.col("_line").alias("corrupt"),
                F.col("_metadata.file_path").alias("file"),
            )
        )
    empty = "timestamp timestamp_ntz, zone int, power double, u10 double, v10 double, u100 double, v100 double, line string, corrupt string, file string"
    rows = union_stations(parts) if parts else spark.createDataFrame([], empty)
    reason = F.when(F.col("corrupt").isNotNull(), "columns").when(F.col("zone").isNull(), "zone").when(F.col("timestamp").isNull(), "timestamp")
    rows = rows.withColumn("reason", reason)
    good = rows.where("reason is null").drop("line", "corrupt", "file", "reason")
    bad = rows.where("reason is not null").select("file", F.coalesce("corrupt", "line").alias("line"), "reason")
    if zones is not None:
        good = good.where(F.col("zone").isin(list(zones)))
    return (good if task is None else good.withColumn("task", F.lit(task))), bad, bad_files


def union_stations(parts: Sequence[DataFrame]) -> DataFrame:
    """One table from several, by column names."""
    if not parts:
        raise ValueError("there is no station table to read")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_report(df: DataFrame, path: str, fmt: str = "csv", partition_by: Sequence[str] = (), single_file: bool = False) -> None:
    """A result table as CSV or Parquet; ``single_file`` is for small reports only."""
    writer = (df.coalesce(1) if single_file else df).write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path)


#: A station-by-time view of the order lines: 10 stations, one row for each station and day, with planted twins (5 of 4, 8
#: of 7), a frozen month (9), speeds out of range (2) and gaps (3). The same text runs in Spark SQL and DuckDB.
WIND_CTES = """
r as (
  select cast(l_suppkey % 10 as int) + 1 as zone, l_shipdate as ts, max(l_discount) * 10 as pw, max(l_tax) * 12.5 as pw2,
         min(l_quantity) as qlo, max(l_quantity) as qhi, max(l_tax) as tx
  from {lineitem} group by l_suppkey % 10, l_shipdate),
z as (
  select zone, ts, pw, qlo, qhi, tx from r where zone not in (5, 8)
  union all select 5, ts, pw2, qlo, qhi, tx from r where zone = 4
  union all select 8, ts, pw2, qlo, qhi, tx from r where zone = 7),
wind as (
  select ts, zone,
    case when zone = 3 and extract(day from ts) = 31 then null else pw end as power,
    case when zone = 9 and extract(month from ts) = 2 then 1.5 else (qlo - 25) / 6 end as u10,
    case when zone = 9 and extract(month from ts) = 2 then 2.0 else (tx * 100 - 3) / 2 end as v10,
    case when zone = 9 and extract(month from ts) = 2 then 3.0
         when zone = 2 and extract(month from ts) = 1 and extract(day from ts) = 1 then 80.0
         else (qhi - 22) / 3 end as u100,
    case when zone = 9 and extract(month from ts) = 2 then 4.0 else tx * 100 - 3 end as v100
  from z)"""


ROWS_A_TASK = 250_000


def tasks_of(spark: SparkSession, sf_dir: str) -> int:
    """Partitions for the view by supplier, so that a task's rows stay as many whatever the size of the tables."""
    return -(-spark.read.parquet(f"{sf_dir}/lineitem.parquet").count() // ROWS_A_TASK)


def wind_view(spark: SparkSession, sf_dir: str, by_supplier: bool = False) -> DataFrame:
    """The view; ``by_supplier`` makes each supplier a station, so that their number grows with the tables."""
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    if by_supplier:  # dealt by the view's own groups, which are hardly larger than a row each
        lineitem = lineitem.repartition(max(1, tasks_of(spark, sf_dir)), "l_suppkey", "l_shipdate")
    ctes = WIND_CTES.replace("cast(l_suppkey % 10 as int) + 1", "cast(l_suppkey as int)").replace("l_suppkey % 10", "l_suppkey") if by_supplier else WIND_CTES
    return spark.sql(f"with {ctes} select * from wind", lineitem=lineitem)
