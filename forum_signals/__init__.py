"""Spark-native analytics of miscommunication signals in question-and-answer forums."""

__version__ = "0.1.0"
