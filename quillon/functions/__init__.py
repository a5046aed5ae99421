"""Column functions: text kernel, identifiers, tool results, token hashing."""
