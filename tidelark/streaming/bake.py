"""A fitted recipe on a stream: its bake is a projection, so it needs no state."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..plans.recipe import FittedRecipe


def bake_stream(stream: DataFrame, fitted: FittedRecipe) -> DataFrame:
    if not stream.isStreaming:
        raise ValueError("not a streaming DataFrame")
    return fitted.bake(stream)
