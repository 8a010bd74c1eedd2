"""Spark-native analytics for asynchronous automata networks and their Markov chains."""

__version__ = "0.1.0"
