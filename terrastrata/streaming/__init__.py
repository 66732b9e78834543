"""Strata of a stream of pixels, with fixed breaks: a stateless projection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from ..operators.stratify import binned, combined
from ..sources.raster import quoted


def stratified(stream: DataFrame, breaks: Mapping[str, Sequence[float]], map: bool = False) -> DataFrame:  # noqa: A002
    """The stream with strat_<band> for each band, and strat_map if asked for; works on batches as well."""
    cuts = {b: sorted(float(x) for x in c) for b, c in breaks.items()}
    out = stream.withColumns({f"strat_{b}": binned(quoted(b), c) for b, c in cuts.items()})
    if map:
        out = out.withColumn("strat_map", combined([(quoted(f"strat_{b}"), len(c) + 1) for b, c in cuts.items()]))
    return out

