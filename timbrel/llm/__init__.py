"""Operators for text corpora: one module per operator, all importing only general helpers."""
