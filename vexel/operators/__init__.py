"""Vexel operators."""
