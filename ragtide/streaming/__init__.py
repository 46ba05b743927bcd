"""Arrays over streams."""
