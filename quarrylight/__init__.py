"""Spark-native medallion analytics engine."""
