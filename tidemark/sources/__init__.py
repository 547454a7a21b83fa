"""Table scans with fixed schemas, and views of stand-in tables."""
