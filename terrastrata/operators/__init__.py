"""Statistics, stratification and sampling over pixel tables."""
