"""Trajectory functions."""
