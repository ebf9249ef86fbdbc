"""Column-level functions (geo, dates, text). Built-in Spark expressions only."""

from . import dates, geo, text

__all__ = ["dates", "geo", "text"]
