"""Column functions on sequences, records and qualities."""
