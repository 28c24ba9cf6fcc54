"""Column-level helpers: roles, safe casts, ratios and text clean-up."""
