"""Spark-native observation of text that machines read and people do not see."""
