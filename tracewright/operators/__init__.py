"""Cleaning, windows, labels, features, models, calibration, attacks and evaluation over frame tables."""
