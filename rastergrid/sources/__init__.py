"""GeoTIFF and shapefile data sources, file listings and sinks."""
