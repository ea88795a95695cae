"""tabsmith: automated profiling, feature building, model training and scoring
of tabular data as Spark DataFrame / Spark ML / Structured Streaming jobs."""

__version__ = "0.1.0"
