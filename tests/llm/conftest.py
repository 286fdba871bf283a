"""The session of the other tests; ``tests/conftest.py`` defines it."""
