"""Operators that prepare large text corpora for language-model training."""
