"""Bitemporal revision analytics on Spark."""
