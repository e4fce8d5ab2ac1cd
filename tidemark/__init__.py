"""Text-to-answer data jobs on Spark."""
