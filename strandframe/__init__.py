"""Sequencing-read analytics on Spark DataFrames."""

from strandframe.schema import Meta, ReadSet

__all__ = ["Meta", "ReadSet"]
