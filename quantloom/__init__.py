"""Quantitative market research tables and statistics on Apache Spark."""
