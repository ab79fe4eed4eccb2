"""Column functions: text, rules and scores."""
