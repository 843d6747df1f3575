"""DataFrame operators on reads, regions, window calls and records."""
