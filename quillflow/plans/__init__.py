"""Queries over the star schema and the document tables, and their SQL."""
