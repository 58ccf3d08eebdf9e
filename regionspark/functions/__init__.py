"""Column functions: projection, ring algebra, request values."""
