"""Column functions: text, markup, embeddings."""
