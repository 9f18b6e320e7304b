"""Timeline analytics for fleets of clips: DataFrame-to-DataFrame operators for Spark."""
