"""streaming of the knowledge base."""
