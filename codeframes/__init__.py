"""Re-expresses screen-capture code recovery as DataFrame transformations."""

__version__ = "0.1.0"
