"""The search language of the rendered page, facets and the state in a URL, as column expressions."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple
from urllib.parse import parse_qs, urlencode

from pyspark.sql import Column
from pyspark.sql import functions as F


class Term(NamedTuple):
    field: str | None
    needle: str
    negated: bool


def tokens(text: str) -> list[str]:
    """Split at white space outside double quotes; quotes vanish."""
    out, now, quoted = [], "", False
    for ch in text.lower():
        if ch == '"':
            quoted = not quoted
        elif ch.isspace() and not quoted:
            out.append(now)
            now = ""
        else:
            now += ch
    return [t for t in (*out, now) if t]


def parse(text: str, fields: set[str]) -> list[Term]:
    """A leading minus negates; ``field:value`` is one only for known fields, else a literal; empty needles go."""
    out = []
    for t in tokens(text):
        negated = len(t) > 1 and t[0] == "-"
        t = t[negated:]
        field, colon, value = t.partition(":")
        term = Term(field, value, negated) if colon and field in fields else Term(None, t, negated)
        if term.needle:
            out.append(term)
    return out


def matches(terms: list[Term], blob: str = "search") -> Column:
    """All terms hold; a term is a part of its field or of the search blob."""
    tests = [F.coalesce(F.contains(F.lower(F.col(t.field or blob).cast("string")), F.lit(t.needle)), F.lit(False)) != F.lit(t.negated) for t in terms]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def facet(col: str, chosen: list[str], how: str = "any") -> Column:
    """Tokens of an array column: any of the chosen, all of them, or exactly one value of a plain column (``is``)."""
    if not chosen:
        return F.lit(True)
    wanted = F.array(*map(F.lit, chosen))
    if how == "is":
        return F.col(col).isin(chosen)
    return F.size(F.array_except(wanted, F.col(col))) == 0 if how == "all" else F.arrays_overlap(F.col(col), wanted)


def chips(modes: dict[str, str], has: str = "present_features", gaps: str = "gap_features") -> Column:
    """``feature: has | lacks | gap``, all of them."""
    test = {"has": lambda f: F.array_contains(has, f), "lacks": lambda f: ~F.array_contains(has, f), "gap": lambda f: F.array_contains(gaps, f)}
    return reduce(lambda a, b: a & b, [test[m](f) for f, m in modes.items()], F.lit(True))


class State(NamedTuple):
    """What one table of the page is filtered and sorted by."""

    query: str = ""
    facets: dict[str, list[str]] = {}
    features: dict[str, str] = {}
    sort: tuple[int, bool] | None = None


def from_query_string(text: str, table: str, known: set[str]) -> State:
    """Unknown features are dropped, an unknown mode means has."""
    got = {k.removeprefix(f"{table}."): v[-1] for k, v in parse_qs(text.lstrip("?")).items() if k.startswith(f"{table}.")}
    feats = {}
    for item in filter(None, got.pop("feat", "").split(",")):
        mode, colon, f = item.partition(":")
        if not colon:
            mode, f = "has", item
        if f in known:
            feats[f] = mode if mode in ("has", "lacks", "gap") else "has"
    query, sort = got.pop("q", ""), got.pop("sort", "")
    place, _, way = sort.partition(":")
    return State(query, {k: v.split(",") for k, v in got.items() if v}, feats, (int(place), way == "desc") if place.isdigit() else None)


def to_query_string(state: State, table: str) -> str:
    parts = {f"{table}.{k}": ",".join(v) for k, v in state.facets.items() if v}
    if state.query:
        parts[f"{table}.q"] = state.query
    if state.features:
        parts[f"{table}.feat"] = ",".join(f"{m}:{f}" for f, m in state.features.items())
    if state.sort:
        parts[f"{table}.sort"] = f"{state.sort[0]}:{'desc' if state.sort[1] else 'asc'}"
    return urlencode(parts, safe=":,")


def sort_key(col: str, *, numeric: bool) -> Column:
    return F.coalesce(F.col(col).try_cast("double"), F.lit(0.0)) if numeric else F.lower(col)
