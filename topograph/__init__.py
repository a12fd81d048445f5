"""topograph: typed directed property graphs and their analytics as plain Spark plans."""

__version__ = "0.1.0"
