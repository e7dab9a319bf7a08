"""Spark-native cohort estimation and planning analytics."""
