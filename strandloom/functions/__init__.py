"""Column functions over sequences, segments and alignments."""
