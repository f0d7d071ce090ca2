"""File formats of sample sets and models."""
