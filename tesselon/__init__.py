"""Tesselon: full-text, vector and faceted analytics as Spark plans."""
