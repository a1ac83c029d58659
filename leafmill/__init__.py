"""leafmill: document analytics as PySpark DataFrame operators."""
