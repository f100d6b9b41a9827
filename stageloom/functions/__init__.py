"""functions of the stageloom package."""
