"""Duplicate detection and data curation as Spark DataFrame plans."""
