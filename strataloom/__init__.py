"""strataloom: documents to queryable knowledge, as DataFrame plans on Apache Spark."""

__version__ = "0.1.0"
