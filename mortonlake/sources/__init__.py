"""Where points come from."""
