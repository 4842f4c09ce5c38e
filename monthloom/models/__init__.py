"""Survival models on Spark ML."""
