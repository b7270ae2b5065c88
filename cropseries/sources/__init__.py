"""Catalogs, granule metadata, reference libraries, raster tables and logs."""
