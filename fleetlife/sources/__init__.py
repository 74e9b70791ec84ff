"""Readers of fleet files and the result store."""

from .files import (
    check_conditions,
    parse_cycle_lines,
    parse_truth_lines,
    read_curves,
    read_cycle_text,
    read_high_rate,
    read_snapshot_tree,
    read_truth,
    require_channels,
)
from .store import append_results, commit_cells, committed, materialize, read_results, source_key

__all__ = [
    "append_results", "check_conditions", "commit_cells", "committed", "materialize", "parse_cycle_lines",
    "parse_truth_lines", "read_curves", "read_cycle_text", "read_high_rate", "read_results",
    "read_snapshot_tree", "read_truth", "require_channels", "source_key",
]
