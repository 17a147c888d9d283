"""Interval burden analytics and training-data preparation on Spark."""
