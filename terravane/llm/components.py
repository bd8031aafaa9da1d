"""Connected components of a link table; the library's own."""

from __future__ import annotations

from ..operators.components import connected_components

__all__ = ["connected_components"]
