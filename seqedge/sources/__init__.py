"""Readers and sinks for genome, motif, matrix, edge and prediction files."""
