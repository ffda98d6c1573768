"""The gate on a stream."""
