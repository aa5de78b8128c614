"""Spark-native engine for building, labelling, repairing and measuring reasoning-trace data."""
