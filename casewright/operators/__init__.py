"""casewright operators."""
