"""Markup analytics on Spark: token relations, path selection, serialisation, charsets."""
