"""Connected components, as the rest of the library has them."""

from ..operators.graph import components

__all__ = ["components"]
