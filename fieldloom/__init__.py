"""Document field extraction, review and rename planning as Spark jobs."""

__version__ = "0.1.0"
