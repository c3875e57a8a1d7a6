"""functions of the catalogue library."""
