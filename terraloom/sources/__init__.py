"""sources of the geospatial context engine."""
