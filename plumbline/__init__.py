"""Data-correctness analytics on Spark: reconcile, trace, and judge numbers at scale."""
