"""Trajectory plans."""
