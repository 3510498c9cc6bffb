"""Column functions: URLs, text, vectors, topics, ratings."""
