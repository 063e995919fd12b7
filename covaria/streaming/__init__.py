"""Measures over streams of epochs."""
