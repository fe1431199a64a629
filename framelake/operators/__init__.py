"""Trajectory operators."""
