"""Readers of source systems, the table-to-facts mapping, and the parquet fact log."""
