"""DataFrame operators: curation, metrics, runs, preferences, rewards."""
