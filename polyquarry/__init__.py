"""polyquarry: building, checking and scoring multilingual QA benchmarks on Spark."""

__version__ = "0.1.0"
