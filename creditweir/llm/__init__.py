"""Operators for preparing training text: tokens, shards, pages, quality, copies, languages, packing."""
