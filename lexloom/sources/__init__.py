"""Readers and writers of the text interchange formats."""
