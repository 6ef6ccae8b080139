"""Writers of sequence files."""
