"""Content analysis over Spark tables: payload statistics, sketches, near-duplicates, vectors, sets, orderings."""

__version__ = "0.1.0"
