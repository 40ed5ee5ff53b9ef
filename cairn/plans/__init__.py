"""Pipelines and publishing put together from the operators."""
