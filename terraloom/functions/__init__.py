"""functions of the geospatial context engine."""
