"""millrace: a PySpark-native analytics engine (SQL operators and large-scale data processing)."""

__version__ = "0.1.0"
