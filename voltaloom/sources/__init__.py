"""Readers and writers of recordings and feature tables."""
