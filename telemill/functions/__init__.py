"""Column helpers and small reusable DataFrame steps."""
