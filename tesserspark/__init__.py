"""Spark-native structural analysis of particle trajectories."""

__version__ = "0.1.0"
