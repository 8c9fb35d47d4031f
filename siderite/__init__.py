"""Siderite: a PySpark-native engine for collectible-inventory analytics."""

__version__ = "0.1.0"
