"""The functions of the package by name; samplers give their networks as vectors."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from .operators import sample
from .sources.vector import Samples


def _as_vector(sampler: Callable) -> Callable[..., Samples]:
    @wraps(sampler)
    def run(rast, *args, **kwargs) -> Samples:
        return Samples(sampler(rast, *args, **kwargs), rast.meta.crs)

    return run


srs, strat, systematic, clhs = map(_as_vector, (sample.srs, sample.strat, sample.systematic, sample.clhs))
