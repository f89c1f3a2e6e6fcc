"""Snippets of the places where a query's words stand, for texts that a preview doesn't show."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from parlance.plans.query import Query

#: Bytes between two hits of a cluster, bytes of a cluster, clusters of a text, words and phrases of a query.
GAP, SPAN, CLUSTERS, SPECS = 50, 200, 3, 64


def spec_patterns(query: Query) -> list[re.Pattern[str]]:
    """A pattern for each of a query's words, at word starts, and phrases."""
    words = [re.compile(r"(?<![^\W_])" + re.escape(w), re.I) if w.isascii() else re.compile(re.escape(w), re.I) for w in dict.fromkeys(query.words)]
    phrases = []
    for x in query.literals:
        cased = any(c.isupper() for c in x)
        body = r"\s+".join(map(re.escape, re.split(r"\s+", x)))
        phrases.append(re.compile(body, 0 if cased else re.I))
    return (words + phrases)[:SPECS]


@dataclass
class Cluster:
    """Hits near each other: their range, the specs in it, and how often two different ones stand side by side."""

    start: int
    end: int
    specs: set[int] = field(default_factory=set)
    pairs: int = 0
    last: tuple[int, int] = (0, 0)  # spec and end of the last hit


def clusters(text: bytes, hits: list[tuple[int, int, int]]) -> list[Cluster]:
    """Clusters of (start, end, spec) hits in order of their starts."""
    out: list[Cluster] = []
    for start, end, spec in hits:
        here = out[-1] if out else None
        if here is None or start > here.end + GAP or max(here.end, end) - here.start > SPAN:
            out.append(Cluster(start, end, {spec}, 0, (spec, end)))
            continue
        between = text[here.last[1] : start].decode("utf-8", "ignore")
        if spec != here.last[0] and between and not any(c.isalnum() for c in between):
            here.pairs += 1
        here.end = max(here.end, end)
        here.specs.add(spec)
        here.last = spec, end
    return out


def context_ranges(text: str, preview: str, specs: list[re.Pattern[str]]) -> list[tuple[int, int]]:
    """Byte ranges of up to three clusters that show what the preview doesn't; none if it shows all hits.

    Clusters with more specs that the preview lacks come first, then those with more neighbours, with more
    specs, shorter ones and earlier ones. Each chosen one shows something new, as long as there is any.
    """
    raw = text.encode()
    place = lambda i: len(text[:i].encode())
    hits = sorted((place(m.start()), place(m.end()), k) for k, p in enumerate(specs) for m in p.finditer(text))
    missing = {k for k, p in enumerate(specs) if not p.search(preview)}
    if not hits or not missing and len(hits) <= sum(len(p.findall(preview)) for p in specs):
        return []
    found = clusters(raw, hits)
    if missing:
        found = [c for c in found if c.specs & missing]
    found.sort(key=lambda c: (-len(c.specs & missing), -c.pairs, -len(c.specs), c.end - c.start, c.start))
    chosen: list[Cluster] = []
    shown: set[int] = set()
    for c in found:
        if c.specs & missing - shown and len(chosen) < CLUSTERS:
            chosen.append(c)
            shown |= c.specs & missing
    chosen += [c for c in found if c not in chosen][: CLUSTERS - len(chosen)]
    return sorted((c.start, c.end) for c in chosen)


def width(text: str) -> int:
    """Columns that a text takes: two for wide characters, none for combining ones."""
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def fitted(text: str, columns: int) -> str:
    """A text within some columns; a longer one ends in an ellipsis."""
    if width(text) <= columns:
        return text
    out, used = [], 0
    for c in text:
        used += width(c)
        if used > columns - 1:
            break
        out.append(c)
    return "".join(out).rstrip() + "…"


def snippet(text: str, ranges: list[tuple[int, int]], columns: int) -> str:
    """The ranges with as much around each as the columns allow, joined by ellipses."""
    if not ranges:
        return ""
    raw = text.encode()
    share = max(columns // len(ranges) - 2, 8)
    parts = []
    for start, end in ranges:
        hit = raw[start:end].decode("utf-8", "ignore")
        room = max(share - width(hit), 0)
        before = raw[max(start - 4 * room, 0) : start].decode("utf-8", "ignore")[-(room // 2) :] if room // 2 else ""
        after = raw[end : end + 4 * room].decode("utf-8", "ignore")[: room - room // 2]
        shown = " ".join(f"{before}{hit}{after}".split())
        parts.append(("…" if start > len(before.encode()) else "") + shown)
    tail = "…" if ranges[-1][1] + len(after.encode()) < len(raw) else ""
    return fitted(" ".join(parts) + tail, columns)


def context_lines(texts: DataFrame, query: Query, key: str = "conv_id", columns: int = 160) -> DataFrame:
    """(key, ranges, snippet) of (key, text, preview) rows: one row each, empty where the preview shows all."""
    specs = spec_patterns(query)
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            rows = list(zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True))
            found = [context_ranges(t or "", p or "", specs) for t, p in rows]
            ranges = pa.array([[{"start": a, "end": b} for a, b in x] for x in found], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([part.column(0), ranges, pa.array([snippet(t or "", x, columns) for (t, _), x in zip(rows, found, strict=True)], pa.string())], names=[key, "ranges", "snippet"])

    return texts.select(key, "text", "preview").mapInArrow(run, f"`{key}` {kind}, ranges array<struct<start:long,end:long>>, snippet string")
