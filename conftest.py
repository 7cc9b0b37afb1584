"""Puts the repository on the import path of tests."""
