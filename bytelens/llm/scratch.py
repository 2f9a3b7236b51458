"""The library's tables in the shared folder, under the name that the operators here use."""

from bytelens.scratch import Scratch, ordered

__all__ = ["Scratch", "ordered"]
