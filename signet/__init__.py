"""Signed and directed graph analytics on Spark."""
