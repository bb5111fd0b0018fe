"""casewright streaming."""
