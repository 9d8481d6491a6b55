"""Composite plans: the flagship summary build and snapshot export."""
