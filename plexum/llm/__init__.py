"""Training-corpus operators."""
