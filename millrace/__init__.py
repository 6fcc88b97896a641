"""Document, text, vector and array analytics as declarative Spark queries."""
