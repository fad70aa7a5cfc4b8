"""Reads, merges, pruning, garbage collection and compaction as DataFrame plans."""
