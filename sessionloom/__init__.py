"""Spark operators for recorded table-top sessions and text corpora."""
