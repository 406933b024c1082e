"""Clinic and marketing analytics as composable Spark DataFrame operators."""
