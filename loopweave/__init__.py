"""Spark-first analytics over dependency graphs, their source files, patches and answers."""

__version__ = "0.1.0"
