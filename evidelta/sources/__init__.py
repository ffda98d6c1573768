"""JSON lines in and out, and fetching from outside."""
