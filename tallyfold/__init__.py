"""Tallyfold: a PySpark-native engine for contact-data analytics."""
