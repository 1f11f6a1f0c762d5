"""Sea-ice, iceberg-track, ice-chart and route analytics as Spark DataFrames."""
