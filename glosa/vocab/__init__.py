"""Word lists, country table and emoji table."""
