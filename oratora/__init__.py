"""Oratora: speech analytics and text processing on Spark."""
