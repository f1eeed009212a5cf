"""Readers and writers of sequence and graph text formats over Spark's own text source."""
