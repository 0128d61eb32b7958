"""Specs, end-to-end plans and the registered queries."""
