"""streaming of the catalogue library."""
