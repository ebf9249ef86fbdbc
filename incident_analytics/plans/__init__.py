"""Plan-level helpers: materialising small intermediate results, plan checks."""

from .materialize import materialize
from .inspect import plan_text, physical_operators

__all__ = ["materialize", "plan_text", "physical_operators"]
