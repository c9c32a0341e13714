"""Column functions of the dialect, for use on any DataFrame."""

from .arithmetic import compare, divide, negate, saturating_add, saturating_multiply, saturating_subtract

__all__ = ["compare", "divide", "negate", "saturating_add", "saturating_multiply", "saturating_subtract"]
