"""Browse the scheme catalog: search, filter, badge, order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import ALL, NATIONAL
from ..functions.text import col, or_empty
from .positions import with_positions

ANY = "All"
CENTRAL = "Central"


def _holds(text: Column | str, term: str) -> Column:
    return F.lower(or_empty(text)).contains(term.lower())


def matches_search(term: str | None) -> Column:
    """P9."""
    if not term:
        return F.lit(True)
    return _holds("name", term) | _holds("description", term)


def matches_audience(audience: str) -> Column:
    """P10."""
    if audience == ANY:
        return F.lit(True)
    return _holds("target_beneficiaries", audience) | _holds("description", audience)


def effective_state() -> Column:
    """First listed rule state, else the scheme's state, else national."""
    return F.coalesce(
        F.get(F.col("rules.state"), F.lit(0)),
        F.nullif(F.col("state"), F.lit("")),
        F.lit(NATIONAL),
    )


def is_central(state: Column | str) -> Column:
    state = or_empty(state)
    return (state == "") | (state == NATIONAL) | (F.lower(state) == ALL)


def matches_state(selected: str) -> Column:
    """A named state keeps its own rows and the national ones."""
    if selected == ANY:
        return F.lit(True)
    state = effective_state()
    national = (state == NATIONAL) | (F.lower(state) == ALL)
    if selected == NATIONAL:
        return national
    return national | (F.lower(state) == selected.lower())


def state_badge() -> Column:
    """P13."""
    state = effective_state()
    return F.when(is_central(state), F.lit(CENTRAL)).otherwise(state)


def name_like(text: Column | str, pattern: str) -> Column:
    """Case-insensitive pattern chosen by the caller."""
    return col(text).rlike(f"(?i){pattern}")


def find_by_name(schemes: DataFrame, pattern: str) -> DataFrame:
    """The first scheme in catalog order whose name matches. A top-1, not a sort."""
    return schemes.where(name_like("name", pattern)).orderBy("pos").limit(1)


def state_rank(selected: str) -> Column:
    """0 for rows of the selected state, 1 for the rest."""
    if selected in (ANY, NATIONAL):
        return F.lit(1)
    return F.when(F.lower(effective_state()) == selected.lower(), 0).otherwise(1)


def browse(
    schemes: DataFrame, search: str | None = None, audience: str = ANY, state: str = ANY
) -> DataFrame:
    """Filtered catalog, the selected state's rows first, else catalog order."""
    kept = schemes.where(matches_search(search) & matches_audience(audience) & matches_state(state))
    return (
        kept.withColumn("badge", state_badge())
        .withColumn("state_rank", state_rank(state))
        .orderBy("state_rank", "pos")
    )


def browse_order(
    schemes: DataFrame, search: str | None = None, audience: str = ANY, state: str = ANY
) -> DataFrame:
    """T3 as data: the filtered catalog with each row's ``position`` in the order of ``browse``."""
    kept = schemes.where(matches_search(search) & matches_audience(audience) & matches_state(state))
    ranked = kept.withColumn("badge", state_badge()).withColumn("state_rank", state_rank(state))
    return with_positions(ranked, ["state_rank", "pos"])
