"""docketlake: a PySpark-native engine for large collections of standards-meeting documents."""

__version__ = "0.1.0"
