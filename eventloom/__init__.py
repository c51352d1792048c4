"""A PySpark engine for discrete, timestamped JSON events."""
