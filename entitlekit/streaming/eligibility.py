"""Eligibility over a stream of profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.eligibility import eligible_pairs, match_eligible


def stream_eligibility(
    profile_stream: DataFrame, schemes: DataFrame, display: bool = False, strategy: str = "auto"
) -> DataFrame:
    """The batch match on a streaming profile side; stateless, append output.

    The scheme side is static and its size is measured once, when the query is defined.
    """
    match = match_eligible if display else eligible_pairs
    return match(profile_stream, schemes, strategy)
