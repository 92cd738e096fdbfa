"""Readers and writers: file corpora and versioned table sets."""
