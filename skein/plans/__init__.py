"""The search engine that puts the operators together."""
