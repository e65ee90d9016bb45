"""Sinks: CSV and Parquet listing outputs, per source, snapshots, merged."""
