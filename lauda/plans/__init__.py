"""Lauda subpackage: plans."""
