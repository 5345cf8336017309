"""Readers, writers and collection rules."""
