"""Tag analytics: operators."""
