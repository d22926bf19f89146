"""Readers, writers and their validation."""
