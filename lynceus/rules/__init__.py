"""rules of the audit engine."""
