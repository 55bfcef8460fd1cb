"""Vexel plans."""
