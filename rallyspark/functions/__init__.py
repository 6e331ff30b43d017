"""Part of rallyspark."""
