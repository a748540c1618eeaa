"""Lodestream: DataFrame operators for content-intelligence pipelines on Spark."""
