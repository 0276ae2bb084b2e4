"""All oracle statements by registered query name."""

from __future__ import annotations

from oracle import impressions, operators, placements, sources


def all_sql() -> dict[str, str]:
    q = {}
    q.update(placements.queries())
    q.update(impressions.queries())
    q.update(operators.queries())
    q.update(sources.queries())
    return q
