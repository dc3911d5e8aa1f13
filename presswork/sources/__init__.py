"""Readers and writers: page tables, the article store, envelopes, side files."""
