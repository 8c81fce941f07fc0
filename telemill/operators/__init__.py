"""Row-level operators, joins and checks."""
