"""hanloom: mining, cleaning, de-duplicating and aligning document collections on Spark."""

__version__ = "0.1.0"
