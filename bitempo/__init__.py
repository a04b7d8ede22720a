"""Bi-temporal graph, vector and retrieval analytics on PySpark."""
