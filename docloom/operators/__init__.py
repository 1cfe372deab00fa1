"""operators of the knowledge base."""
