"""The store: runs in Parquet, a log of batches, a manifest of commits."""
