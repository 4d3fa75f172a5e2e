"""Continuous variants: new landed files, and activity over event time."""
