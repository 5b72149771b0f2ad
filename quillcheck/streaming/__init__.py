"""Jobs over arriving files."""
