"""Column functions: text analysis, stemming, scoring and code lengths."""
