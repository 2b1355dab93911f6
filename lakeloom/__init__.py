"""Spark-native analytics: batch, streaming and corpus operators over DataFrames."""
