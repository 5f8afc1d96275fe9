"""vouchlake: Spark-first analytics over certificates, vulnerabilities and text."""

__version__ = "0.1.0"
