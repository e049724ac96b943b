"""streaming of the geospatial context engine."""
