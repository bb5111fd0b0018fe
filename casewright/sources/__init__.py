"""casewright sources."""
