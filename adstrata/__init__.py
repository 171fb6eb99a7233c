"""Spark-native analytics over time-stamped classified-ad snapshots."""
