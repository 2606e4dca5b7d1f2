"""Spark operators over collections of long texts and the reading of them."""
