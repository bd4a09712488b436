"""Part of the plexum engine."""
