"""Named queries over the project tables, with their SQL."""
