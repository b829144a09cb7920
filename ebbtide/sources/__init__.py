"""Readers, writers and the proxy tables over the given data."""
