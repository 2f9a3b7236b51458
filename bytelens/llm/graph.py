"""The library's connected components, under the name that the operators here use."""

from bytelens.operators.graphs import connected_components

__all__ = ["connected_components"]
