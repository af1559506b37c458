"""Hierarchical topic analytics on Spark."""
