"""docloom: a PySpark-native engine that turns package documentation into queryable knowledge."""

__version__ = "0.1.0"
