"""functions of the listing engine."""
