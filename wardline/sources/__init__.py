"""Scans and sinks: driver parquet tables, EHR stand-in views, CSV/JSON/Parquet IO."""
