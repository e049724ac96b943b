"""operators of the geospatial context engine."""
