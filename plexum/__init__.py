"""Plexum: spatial-molecule, probe and corpus analytics as lazy Spark plans."""
