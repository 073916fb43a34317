"""Lauda subpackage: streaming."""
