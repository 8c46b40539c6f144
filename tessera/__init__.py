"""Partition sets on Spark."""
