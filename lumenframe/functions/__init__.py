"""See the module docstrings of this subpackage."""
