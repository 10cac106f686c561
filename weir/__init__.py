"""weir: Spark operators for triaging, scoring, auditing and mining large tables of text and events."""

__version__ = "0.1.0"
