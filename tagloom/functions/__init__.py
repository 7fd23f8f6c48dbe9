"""Tag analytics: functions."""
