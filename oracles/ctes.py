"""Builds self-contained SQL for the check: the bindings as common table expressions."""

from __future__ import annotations

import string

from pandwerk.sources.bindings import FLAT

VIEWS: dict[str, str] = {}


def view(name: str, sql: str) -> None:
    """Register a named intermediate SELECT that check queries can reference as ``{name}``."""
    VIEWS[name] = sql


def _refs(text: str) -> list[str]:
    return list(dict.fromkeys(f for _, f, _, _ in string.Formatter().parse(text) if f))


def _collect(text: str, done: dict[str, str]) -> None:
    for ref in _refs(text):
        source = FLAT.get(ref) or VIEWS.get(ref)
        if source is None or ref in done:
            continue
        _collect(source, done)
        done[ref] = source.format(**{r: r for r in _refs(source)})


def sql(text: str) -> str:
    """Expand ``{name}`` references into a WITH clause; supplied tables stay as they are."""
    done: dict[str, str] = {}
    _collect(text, done)
    body = text.format(**{r: r for r in _refs(text)})
    if not done:
        return body
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({s})" for n, s in done.items()) + "\n" + body
