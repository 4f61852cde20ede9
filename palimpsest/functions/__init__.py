"""Scalar column functions built from Spark SQL expressions."""
