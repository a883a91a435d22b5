"""Reusable plan shapes: scalar statistics, skew-safe joins, ordered passes, long-form counts."""
