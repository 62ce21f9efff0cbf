"""Spark-native particle, mesh and deposition analytics."""
