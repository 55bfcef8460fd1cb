"""Vexel functions."""
