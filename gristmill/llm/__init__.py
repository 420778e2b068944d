"""Operators for text corpora: tokenizing, mixing, credential and spam detection. Nothing else in the library imports this."""
