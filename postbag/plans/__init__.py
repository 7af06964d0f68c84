"""Query specifications and their compilation."""
