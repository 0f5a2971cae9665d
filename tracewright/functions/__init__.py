"""Scalar functions and quantiles as column expressions."""
