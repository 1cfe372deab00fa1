"""functions of the knowledge base."""
