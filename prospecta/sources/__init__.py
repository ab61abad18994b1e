"""Readers: registry CSV layouts, JSON payloads, staged/partitioned parquet, and the
adapter that derives registry-shaped tables from the driver's test tables."""
