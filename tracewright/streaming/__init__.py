"""Frames as they arrive: the same windows and scores as in batch."""
