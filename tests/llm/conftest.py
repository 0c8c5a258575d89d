"""The session fixture comes from tests/conftest.py."""
