"""Readers and writers of comment dumps."""
