"""plans of the listing engine."""
