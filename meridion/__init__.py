"""meridion: spatial, raster, network and event-log analytics as Spark DataFrame jobs."""
