"""operators of the listing engine."""
