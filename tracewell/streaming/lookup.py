"""Name lookups on a stream: each micro-batch against a static mapping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..operators.chain import Hop, hop_chain


def resolve_stream(queries: DataFrame, start: str, hops: Sequence[Hop]) -> DataFrame:
    """``hop_chain`` over a streaming DataFrame.

    All hops are stream-static left joins, which keep no state, so neither a watermark nor a
    bound on the stream is needed.
    """
    return hop_chain(queries, start, hops)
