"""Operators on recordings, windows of them and feature tables."""
