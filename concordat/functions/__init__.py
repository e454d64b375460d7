"""Column expressions: text rules of both profiles, numbers, ids and string similarity."""
