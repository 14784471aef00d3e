"""Spark-native comparison of two versions of structured documents."""
