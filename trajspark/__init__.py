"""Spark-native engine for episodic time-series data."""
