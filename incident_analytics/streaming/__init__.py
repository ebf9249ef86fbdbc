"""Structured Streaming: incremental, restartable ingest of landed CSV files."""

from .ingest import start_ingest

__all__ = ["start_ingest"]
