"""casewright plans."""
