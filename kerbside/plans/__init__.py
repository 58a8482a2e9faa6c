"""Composed plans: skew-safe ordering, staging, feeds, tools, refresh job, registered queries."""
