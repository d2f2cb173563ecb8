"""Lodestone: near-duplicate grouping, sessionization and ranking on Spark DataFrames."""
