"""Operators on datasets and their profiles."""
