"""Text and training-data operators; nothing outside this package imports it."""
