"""Business analytics as Spark jobs: reports, bulk validation, posting, streams."""

__version__ = "0.1.0"
