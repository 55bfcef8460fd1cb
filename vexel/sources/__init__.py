"""Vexel sources."""
