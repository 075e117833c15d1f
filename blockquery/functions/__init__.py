"""Small helpers that turn names and texts into column objects."""
