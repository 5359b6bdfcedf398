"""Scalar building blocks: Column in, Column out."""
