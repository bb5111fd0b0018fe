"""casewright functions."""
