"""Correspondence analytics on Spark."""
