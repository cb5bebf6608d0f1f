"""Figures about a run."""

from __future__ import annotations

import resource


def exact_distance_count(n: int) -> int:
    return n * (n - 1) if n > 1 else 0


def descent_distance_estimate(n: int, k: int, iterations: int) -> int:
    return iterations * n * k * k


def peak_memory_mb() -> float:
    """Of the driver's Python; JVMs and executors are not in it."""
    return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024


def counters(n: int, d: int, k: int, recall: float, distances: int) -> dict[str, float]:
    return {"recall_at_k": recall, "peak_memory_mb": peak_memory_mb(), "n_distance_computations": distances, "n": n, "d": d, "k": k}
