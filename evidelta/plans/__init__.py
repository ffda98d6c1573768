"""Named queries, their SQL counterparts, and shared physical patterns."""
