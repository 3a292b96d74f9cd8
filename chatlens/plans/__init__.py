"""Building all tables from the sources."""
