"""Operators for text corpora; nothing outside this folder imports them but the query registry's guard."""
