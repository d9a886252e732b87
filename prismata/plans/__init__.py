"""Aggregation plans of the profile."""
