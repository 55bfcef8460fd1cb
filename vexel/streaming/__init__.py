"""Vexel streaming."""
