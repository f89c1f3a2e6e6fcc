"""Driver-side planning: query strings, search modes, time filters and depths. Plain Python."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta, tzinfo

from parlance.functions.text import CJK, SEPARATORS

#: Ranking constants.
WEIGHTS = {"title": 5.0, "summary": 3.0, "project": 4.0, "body": 1.0}
WORD_CAP, PAIR_CAP, PAIR_WEIGHT = 10, 3, 2.0
FRESH_WEIGHT, FRESH_DAYS = 2.0, 7.0
RRF = 60
TOP, WITHIN_TOP, LISTED, HITS_PER_CONVERSATION, READ_RADIUS = 10, 20, 20, 2, 1
QUALITY = ((0.85, "strong"), (0.65, "good"), (0.35, "fair"))
LEXICAL_SHARE, CJK_WEIGHT = 0.2, 0.5


@dataclass(frozen=True)
class Query:
    """A parsed query: words, literals, and whether it is quoted only."""

    words: tuple[str, ...] = ()
    literals: tuple[str, ...] = ()
    quoted_only: bool = False
    text: str = ""

    @property
    def empty(self) -> bool:
        return not self.words and not self.literals


def parse_query(text: str) -> Query:
    """A quote begins and ends a literal; one left open ends with the query; blank ones are dropped.

    Terms with an underscore are literals; the rest are normalised words.
    """
    free, literals = [], []
    for i, part in enumerate(text.split('"')):
        if i % 2 == 0:
            free.append(part)
        elif part.strip():
            literals.append(part)
    terms = " ".join(free).split()
    literals += [t for t in terms if "_" in t]
    plain = " ".join(t for t in terms if "_" not in t)
    words = re.sub(rf"[\s{SEPARATORS}]", " ", plain).lower().split()
    return Query(tuple(words), tuple(literals), bool(literals) and not "".join(free).strip(), text)


def exact_query(text: str) -> Query:
    """The whole query as one phrase, unless it is quoted only already."""
    parsed = parse_query(text)
    return parsed if parsed.quoted_only else parse_query('"' + text.replace('"', "") + '"')


def resolve_mode(asked: str | None, configured: str | None, query: Query, offset: int = 0) -> str:
    mode = asked or configured or "lexical"
    if query.quoted_only:
        return "exact"
    return "lexical" if mode == "hybrid" and offset > 0 else mode


def clamp(n: int, low: int, high: int) -> int:
    return max(low, min(n, high))


def shortlist(top: int) -> int:
    return clamp(5 * top, 50, 500)


def fusion_depth(top: int, per_conversation: int = 1) -> int:
    return clamp(8 * top * per_conversation, 50, 1000)


@dataclass(frozen=True)
class TimeFilter:
    """A closed window in whole seconds; either bound may be open."""

    after: datetime | None = None
    before: datetime | None = None

    @property
    def active(self) -> bool:
        return self.after is not None or self.before is not None


_UNITS = {"s": "seconds", "m": "minutes", "h": "hours", "d": "days", "w": "weeks"}


def _local(at: datetime, zone: tzinfo, late: bool) -> datetime:
    """A wall time in a zone: of two the earlier or the later one, and one that is skipped moves on."""
    found = at.replace(tzinfo=zone, fold=int(late))
    again = found.astimezone(UTC).astimezone(zone)
    return found if again.replace(tzinfo=None) == at else at.replace(tzinfo=zone, fold=0).astimezone(UTC).astimezone(zone)


def parse_time(text: str, now: datetime, upper: bool = False, zone: tzinfo = UTC) -> datetime:
    """An RFC 3339 time, a date with optional minutes or seconds in a zone, or a span before now such as 1w2d
    or 3mo.

    An upper bound reaches to the end of the date, minute or second that it names.
    """
    text = text.strip()
    if re.fullmatch(r"(?:\d+(?:mo|y|[smhdw]))+", text):
        at = now
        for n, unit in re.findall(r"(\d+)(mo|y|[smhdw])", text):
            at = _months_before(at, int(n) * (12 if unit == "y" else 1)) if unit in ("mo", "y") else at - timedelta(**{_UNITS[unit]: int(n)})
        return at
    for pattern, width in (("%Y-%m-%d", timedelta(days=1)), ("%Y-%m-%dT%H:%M", timedelta(minutes=1)), ("%Y-%m-%dT%H:%M:%S", timedelta(seconds=1))):
        try:
            at = datetime.strptime(text.replace(" ", "T"), pattern)
        except ValueError:
            continue
        return (_local(at + width, zone, True).astimezone(UTC) - timedelta(microseconds=1)).astimezone(zone) if upper else _local(at, zone, False)
    at = datetime.fromisoformat(text)
    return at if at.tzinfo else _local(at, zone, upper)


def _months_before(at: datetime, n: int) -> datetime:
    month = at.year * 12 + at.month - 1 - n
    year, month = divmod(month, 12)
    for day in range(at.day, 27, -1):  # a day that the month lacks becomes its last
        try:
            return at.replace(year=year, month=month + 1, day=day)
        except ValueError:
            continue
    return at.replace(year=year, month=month + 1, day=min(at.day, 28))


def time_filter(now: datetime, since: str | None = None, after: str | None = None, before: str | None = None, zone: tzinfo = UTC) -> TimeFilter:
    low = [parse_time(t, now, zone=zone) for t in (since, after) if t]
    window = TimeFilter(max(low) if low else None, parse_time(before, now, True, zone) if before else None)
    if window.after and window.before and window.after > window.before:
        raise ValueError("the window ends before it begins")
    return window


@dataclass(frozen=True)
class Ref:
    """mN, mN..mM, mN.K (a call), sN (a sub-agent)."""

    first: int
    last: int
    call: int | None = None
    kind: str = field(default="message")


def parse_ref(text: str) -> Ref:
    if m := re.fullmatch(r"m(\d+)(?:\.\.m(\d+))?", text):
        first, last = int(m[1]), int(m[2] or m[1])
    elif m := re.fullmatch(r"m(\d+)\.(\d+)", text):
        return Ref(int(m[1]), int(m[1]), int(m[2]))
    elif m := re.fullmatch(r"s(\d+)", text):
        return Ref(int(m[1]), int(m[1]), kind="subagent")
    else:
        raise ValueError(f"invalid-ref: {text}")
    if first < 1 or last < first:
        raise ValueError(f"invalid-ref: {text}")
    return Ref(first, last)


def is_cjk(word: str) -> bool:
    return re.search(CJK, word) is not None
