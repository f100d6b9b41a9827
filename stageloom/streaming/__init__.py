"""streaming of the stageloom package."""
