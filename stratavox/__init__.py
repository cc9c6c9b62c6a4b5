"""Timeline analytics on Spark: paragraphs, screens, alignment, rebuild plans, as DataFrame transforms."""
