"""Spark-native event, risk and corpus analytics."""
