"""Failure analytics for continuous integration, written as PySpark operators."""
