"""Row generators over sequences: k-mers, packed k-mers and their counts."""
