"""Incremental runs and stateful replay."""
