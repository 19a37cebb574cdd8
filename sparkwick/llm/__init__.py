"""Operators that prepare text, embeddings and web pages for language-model training."""
