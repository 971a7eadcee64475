"""Column expressions: text, identifiers, similarity, hashing, scores and extraction."""
