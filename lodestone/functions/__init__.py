"""Column functions: text analysis, scoring formulas, URLs, HTML."""
