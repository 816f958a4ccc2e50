"""sources of the listing engine."""
