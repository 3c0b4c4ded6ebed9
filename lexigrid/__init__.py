"""lexigrid: a Spark-first engine for language analytics over large text collections."""

__version__ = "0.1.0"
