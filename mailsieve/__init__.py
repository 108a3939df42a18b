"""Email threat analytics as DataFrame transformations."""
