"""Makes the repository importable for tests."""
