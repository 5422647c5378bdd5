"""rastergrid: gridded raster and vector analytics as plain Spark DataFrame jobs."""
