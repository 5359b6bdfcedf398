"""Composed jobs: what is computed for each kind of object and each metric."""
