"""Report files in, typed tables and JSON sections out."""
