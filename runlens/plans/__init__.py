"""Reports: each function returns one lazily planned DataFrame."""
