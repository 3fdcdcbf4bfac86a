"""Registered queries with their SQL, by subject."""
