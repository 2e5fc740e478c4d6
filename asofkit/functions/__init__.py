"""Column functions: each maps columns to a column and needs no session."""
