"""Index, searches, batch operators and joins."""
