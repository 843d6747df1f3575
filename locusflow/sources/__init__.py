"""Text sources and sinks for regions and variant records."""
