"""Versioned-log analytics on PySpark: as-of reads, tiered runs, compaction, recovery and metrics."""
