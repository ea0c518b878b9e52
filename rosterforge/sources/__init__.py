"""Readers and writers of the library's stored forms."""
