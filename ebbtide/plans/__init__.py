"""Composite jobs: what a user of the screener asks for."""
