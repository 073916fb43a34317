"""Lauda subpackage: sources."""
