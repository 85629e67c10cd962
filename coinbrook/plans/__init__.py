"""Registered queries and the tables they read."""
