"""Reading, cleaning and keeping tables."""
