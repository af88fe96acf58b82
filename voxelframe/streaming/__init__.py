"""Collections over streams of records."""
