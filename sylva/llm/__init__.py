"""Training-data pipeline operators (self-contained; nothing else in the package imports this)."""
