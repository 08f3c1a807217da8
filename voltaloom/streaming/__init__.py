"""Windows and clusters of events as they arrive; the same functions hold for tables."""
