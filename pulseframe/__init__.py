"""Wearable-sensor analytics as lazily composed PySpark DataFrame operators."""
