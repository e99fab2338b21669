"""tidemark: a Spark-native analytics engine for multi-tenant, classified event streams."""

__version__ = "0.1.0"
