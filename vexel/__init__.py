"""Vexel: vector search, clustering and their upkeep as Spark DataFrame plans."""

__version__ = "0.1.0"
