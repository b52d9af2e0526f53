"""Switches for behaviours that define results; the defaults give the established ones."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Compat:
    sig6: bool = True  # scores are kept to six significant digits
    truncate_coverage: bool = True  # coverage is a whole percentage, cut off
    strict_split: bool = False  # split genes only where siblings do not overlap
    count_terminal_gaps: bool = False  # leading and trailing gaps count as deletions


DEFAULT = Compat()
