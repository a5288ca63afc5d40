"""sinks of the audit engine."""
