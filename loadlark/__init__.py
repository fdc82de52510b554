"""Freight-dispatch analytics expressed as Spark DataFrame plans."""
