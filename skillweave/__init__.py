"""Evolving requirement graphs from text evidence, as Spark DataFrame transformations."""
