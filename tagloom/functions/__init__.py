"""Column functions: entities, escapes, charsets."""
