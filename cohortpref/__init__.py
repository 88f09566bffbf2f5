"""Preference rankings of customer clusters, on Spark."""
