"""Sensitive-data detection, tracking and redaction as Spark DataFrame plans."""
