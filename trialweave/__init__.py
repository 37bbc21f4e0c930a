"""Spark-native batch experiments with speech-response systems."""
