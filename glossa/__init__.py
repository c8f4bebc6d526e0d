"""Acronym and text analytics on Spark's DataFrame API."""
