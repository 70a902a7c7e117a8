"""windlake: Spark jobs for station-by-time wind and power data."""
