"""See the README for the catalogue."""
