"""Annotated-span evaluation engine for Spark."""
