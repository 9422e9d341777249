"""Spark-native memory, vector and graph retrieval engine.

The ordered operation log is the table; state, adjacency, counters and
statistics are relational views of it. See README.md for the map of modules.
"""
