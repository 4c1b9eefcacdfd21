"""Conversation analytics on Spark: privacy-floored cells, calendars, period comparison, labels and guards."""
