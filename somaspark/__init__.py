"""Spark-native operators for interval, pileup and variant tables."""
