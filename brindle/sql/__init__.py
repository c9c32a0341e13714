"""The SQL dialect: tokens, statements, validation."""

from .parser import parse, parse_expression, parse_one
from .validator import validate

__all__ = ["parse", "parse_expression", "parse_one", "validate"]
