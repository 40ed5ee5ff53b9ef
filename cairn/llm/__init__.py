"""Training-data operators: sharding, deduplication, quality, toxicity, tokens, chat, pages.

Nothing outside this subpackage imports it.
"""
