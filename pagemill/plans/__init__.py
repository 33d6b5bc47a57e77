"""Format registry, conversion routes and tool applicability as relations."""
