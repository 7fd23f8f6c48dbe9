"""Tag analytics: sources."""
