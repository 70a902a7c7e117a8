"""Wind resource assessment: stations to site table, totals, strongest speed bins and uncertainty budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from windlake.functions.physics import shear_from_two_levels
from windlake.operators import features, resource
from windlake.sources.scratch import Scratch
from windlake.sources.stations import write_report


def run(spark: SparkSession, stations: DataFrame, out: str, hub: float = 100.0, capacity_mw: float = 50.0, curve: DataFrame | None = None) -> dict[str, DataFrame]:
    """Writes and returns the site table, its totals, the strongest speed bins, mean shear and uncertainty budget. ``curve`` (x, y)
    is a turbine's own power curve, in the place of the typical one."""
    d = features.with_speeds(stations).withColumn("shear", shear_from_two_levels("ws100", "ws10"))
    d = Scratch(spark, "resource").put(d.select("zone", "ws10", "ws100", "shear"), "speeds")
    table = Scratch(spark, "resource").put(resource.site_resource_table(spark, d, hub, capacity_mw, curve=curve), "sites")
    detail = resource.aep_detail(spark, table, capacity_mw, curve=curve)
    results = {"sites": table, "totals": resource.resource_totals(table), "top_bins": resource.top_bins(detail), "mean_shear": resource.mean_shear(d), "uncertainty": resource.uncertainty_budget(spark)}
    for name, df in results.items():
        write_report(df, f"{out}/{name}", "parquet")
    return {name: spark.read.parquet(f"{out}/{name}") for name in results}
