"""Termloom: text-retrieval analytics on PySpark."""
