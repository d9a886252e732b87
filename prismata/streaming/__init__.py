"""Profiles of growing data."""
from .incremental import IncrementalProfile  # noqa: F401
