"""Operators: metadata, joins, aggregates, statistics, ranking, splits and models."""
