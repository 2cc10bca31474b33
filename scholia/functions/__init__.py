"""Column expressions; Python only where Unicode normalisation or fuzzy ratios need it."""
