"""Scroll-transcript analytics as composable PySpark DataFrame transformations."""
