"""Reading listings (CSV, derived from tables), row identity, sinks and stage tables."""
