"""Continuous ingest and the current state of a stream of versions."""
