"""Operators for cleaning and packing large text corpora; nothing outside this folder imports them."""
