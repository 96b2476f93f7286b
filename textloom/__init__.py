"""textloom ."""
