"""Kadastra: a PySpark-native analytics engine for property offers, auctions and tenders."""

__version__ = "0.1.0"
