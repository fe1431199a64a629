"""Trajectory sources."""
