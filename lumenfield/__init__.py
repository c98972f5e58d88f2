"""Spatial-scene analytics expressed as Spark DataFrame programs."""
