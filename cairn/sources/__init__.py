"""Readers: feeds, pages, search responses, stores, and the union of channels."""
