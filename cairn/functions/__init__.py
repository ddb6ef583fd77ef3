"""Column functions over text, time and numbers."""
