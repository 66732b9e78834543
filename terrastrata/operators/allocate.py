"""How many samples each stratum gets: whole-number arithmetic on the driver, over one row for each stratum."""

from __future__ import annotations

import math
import warnings
from collections.abc import Sequence

METHODS = ("prop", "equal", "manual", "optim")


def allocate(num_samples: int, method: str, counts: Sequence[int], weights: Sequence[float] | None = None) -> list[int]:
    """Samples for each stratum, from its pixel count.

    prop: one for each ceil(pixels / samples) pixels; equal: the same for all; manual and optim: by weight. What is left is
    dealt evenly, the surplus to the low strata. No stratum gets more than it has pixels, and what that takes away is
    not dealt anew. Without pixels there are no samples.
    """
    if method not in METHODS:
        raise ValueError(f"unknown allocation {method!r}")
    strata, total = len(counts), sum(counts)
    if not strata or not total:
        return [0] * strata
    if method == "prop":
        per_sample = math.ceil(total / num_samples)
        quota = [n // per_sample for n in counts]
    elif method == "equal":
        quota = [num_samples // strata] * strata
    else:
        if weights is None or len(weights) != strata:
            raise ValueError("there must be a weight for each stratum")
        quota = [math.floor(num_samples * w + 1e-9) for w in weights]
    left = num_samples - sum(quota)
    quota = [q + left // strata + (h < left % strata) for h, q in enumerate(quota)]
    short = [h for h, (q, n) in enumerate(zip(quota, counts, strict=True)) if q > n]
    if short:
        warnings.warn(f"strata {short} have fewer pixels than samples", stacklevel=2)
    return [min(q, n) for q, n in zip(quota, counts, strict=True)]


def optimal_weights(counts: Sequence[int], deviations: Sequence[float]) -> list[float] | None:
    """Neyman's weights: pixels times standard deviation, in shares; None where no stratum varies."""
    products = [n * (s or 0.0) for n, s in zip(counts, deviations, strict=True)]
    whole = sum(products)
    return [p / whole for p in products] if whole else None
