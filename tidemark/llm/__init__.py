"""Operators for training-data pipelines: each reads whole tables and whole texts."""
