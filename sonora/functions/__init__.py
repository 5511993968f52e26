"""Column functions and numpy helpers."""
