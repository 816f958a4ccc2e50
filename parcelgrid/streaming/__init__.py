"""streaming of the listing engine."""
