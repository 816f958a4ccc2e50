"""Listing analytics as composable Spark DataFrame operators."""
