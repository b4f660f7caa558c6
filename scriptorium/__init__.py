"""Scriptorium: a PySpark-native engine for personalised-text experiment data."""
