"""sealwork: evidence analytics on Spark DataFrames."""

__all__ = ["constants", "session"]
