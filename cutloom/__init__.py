"""Spark-native interval, decision and text-corpus analytics."""
