"""Run-to-failure analytics on fleets of machines, written as Spark DataFrame jobs."""

__version__ = "0.1.0"
