"""plans of the knowledge base."""
