"""Reading source tables, packaged dimensions, and writing results."""
