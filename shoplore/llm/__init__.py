"""Operators for preparing training text: quality, language, toxicity, duplicates, leaks, tokens, chat, shards."""
