"""Lauda subpackage: operators."""
