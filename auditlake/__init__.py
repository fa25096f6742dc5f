"""Text and source-code quality analytics as declarative Spark plans."""
