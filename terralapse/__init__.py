"""Land-cover change detection over raster time series, expressed as Spark plans."""
