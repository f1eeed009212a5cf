"""Operators over tables of reads, k-mers, vertices, edges and paths."""
