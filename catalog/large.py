"""Queries once more by the paths that large tables take."""

from __future__ import annotations

from catalog.base import register_large

for _name in ("quantiles", "describe", "box_stats_grouped", "rank_by", "frequency_table", "duplicate_rows", "running_total", "fill_backward"):
    register_large(_name, sketch_rows=0, broadcast_rows=0, buckets=5)
