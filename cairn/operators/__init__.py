"""Predicates, classifiers, joins, rollups and selections over DataFrames."""
