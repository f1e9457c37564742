"""Factor expressions over (instrument, timestamp) panels, compiled to Spark plans."""
