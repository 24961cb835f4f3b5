"""Artifact-index analytics on PySpark."""
