"""Sensitive-text analytics on Spark: detection, redaction and reversible tokens over DataFrame columns."""
