"""Ordered pipelines built from the operators."""
