"""plans of the geospatial context engine."""
