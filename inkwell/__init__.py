"""A PySpark engine for stylometric analysis of text collections."""

__version__ = "0.1.0"
