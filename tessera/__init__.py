"""Tessera: a PySpark-native engine that turns noisy text into checked records."""
