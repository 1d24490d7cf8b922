"""Settings. Those of cutting and recognition enter a run's key; those of rendering don't."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Cutting:
    segment_ms: int = 60_000
    search_ms: int = 2_000
    min_silence_ms: int = 300
    threshold_db: float = -40.0


@dataclass(frozen=True)
class Recognition:
    model: str = "medium"
    compute_type: str = "int8"
    batch_size: int = 16
    batched: bool = False  # the model takes lists of at most batch_size segments
    task_cpus: int = 0  # what a recognition task asks of a cluster; 0: as the session has it
    task_gpus: float = 0


@dataclass(frozen=True)
class Rendering:
    word_level: bool = False
    allow_partial: bool = False
