"""Stateful viewport and metrics streams."""
