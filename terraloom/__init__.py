"""Set-oriented geospatial context operators on Spark DataFrames."""
