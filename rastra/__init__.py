"""rastra: raster analytics and text pipelines as Spark DataFrames."""
