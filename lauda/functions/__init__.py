"""Lauda subpackage: functions."""
