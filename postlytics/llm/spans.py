"""Spans in texts: kinds, code point offsets, digests."""

from __future__ import annotations

from typing import NamedTuple


class Span(NamedTuple):
    kind: str
    start: int
    end: int


def joined(spans: list[Span], kinds: list[str]) -> str:
    """``kind:start:end`` by start, then kind in the order of ``kinds``, then end, comma-joined."""
    rank = {kind: at for at, kind in enumerate(kinds)}
    ordered = sorted(spans, key=lambda s: (s.start, rank[s.kind], s.end))
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in ordered)

