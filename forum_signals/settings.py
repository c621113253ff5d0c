"""Thresholds of an analysis run and the fixed names of its tables."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class AnalysisSettings:
    """Every cut-off of the pipeline; the defaults are the published study's values."""

    # The published study's thresholds.
    top_n: int = 200
    min_questions: int = 1000
    sample_size: int = 500
    stability_sizes: tuple[int, ...] = (50, 100, 200, 300, 400, 500, 750, 1000)
    stability_runs: int = 10
    stability_tags: int = 5
    alpha: float = 0.05
    # Ours: sampling is a seeded hash order, so a run can be repeated.
    seed: str = "forum-signals"


DEFAULTS = AnalysisSettings()
