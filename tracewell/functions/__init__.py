"""Column functions: text rewrites, text quality, word matching and string similarity."""
