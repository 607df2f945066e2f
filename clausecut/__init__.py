"""clausecut: sentence-boundary datasets from legal text, as Spark DataFrame transformations."""

__version__ = "0.1.0"
