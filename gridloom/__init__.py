"""Gridloom: raster, time-series and table analytics as Spark DataFrame jobs."""
