"""lectern: text-corpus curation, splitting, gating and measurement on Spark."""
