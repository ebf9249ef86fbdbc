"""Incident analytics on Spark: lazy DataFrame → DataFrame functions for
cleaning, storing and querying tables of located, time-stamped incidents."""

from .operators.filters import Circle, IncidentFilter

__all__ = ["Circle", "IncidentFilter"]
__version__ = "0.1.0"
