"""Governed-memory analytics as Spark DataFrame operators."""
