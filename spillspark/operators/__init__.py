"""DataFrame to DataFrame operators: tracks, joins, drift, scoring, rasters."""
