"""Column libraries and Arrow-batched Python functions."""
