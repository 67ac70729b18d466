"""Types and scalar helpers."""
