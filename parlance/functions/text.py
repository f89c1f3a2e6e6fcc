"""Text expressions (Column to Column): normalisation, word-start counting, literals, clean-up."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that count as a space in searched text, besides white space.
SEPARATORS = r"_\-/、。，．・：；？！（）「」『』【】〈〉《》〔〕［］｛｝～"
#: Control strings of terminals, in the order in which they are removed.
TERMINAL = (r"(?s)\x1B[\]P^_].*?(?:\x07|\x1B\\|$)", r"\x1B\[[^@-~]*[@-~]", r"(?s)\x1B.", r"[\p{Cc}&&[^\n\t]]")
CJK = "[一-鿿]"
ALPHANUMERIC = r"[\p{IsAlphabetic}\p{N}]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def collapse(text: Column) -> Column:
    """White-space runs as one space, trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize(text: Column) -> Column:
    """Lower case, each separator as one space."""
    return F.lower(F.regexp_replace(text, rf"(?U)[\s{SEPARATORS}]", " "))


def sanitize(text: Column) -> Column:
    """Without terminal control strings and control characters other than line feed and tab."""
    for pattern in TERMINAL:
        text = F.regexp_replace(text, pattern, "")
    return text


def contains_cjk(text: Column) -> Column:
    return text.rlike(CJK)


def _quote(word: str) -> str:
    return r"\Q" + word.replace(r"\E", r"\E\\E\Q") + r"\E"


def _overlaps(word: str) -> bool:
    """Whether two occurrences of a word can overlap: a beginning of it is also an end."""
    return any(word.startswith(word[i:]) for i in range(1, len(word)))


def prefix_count(text: Column, word: str, cap: int = 10) -> Column:
    """Occurrences of a word at word starts, ``cap`` at most.

    Occurrences are taken from left to right without overlap first, then those after a letter or
    digit are left out, so "xa.a.a" holds no "a.a". Where occurrences can't overlap that is one regular
    expression. A plain search goes before either.
    """

    def count(parts: Column) -> Column:
        heads = F.slice(parts, 1, F.size(parts) - 1)
        last = lambda x, i: F.when(x != "", F.right(x, F.lit(1))).when(i == 0, "").otherwise(word[-1])
        return F.size(F.filter(heads, lambda x, i: ~last(x, i).rlike(ALPHANUMERIC)))

    found = let(F.split(text, _quote(word), -1), count) if _overlaps(word) else F.regexp_count(text, F.lit(f"(?<!{ALPHANUMERIC}){_quote(word)}"))
    return F.least(F.when(F.contains(text, F.lit(word)), found).otherwise(0), F.lit(cap)).cast("int")


def has_word(text: Column, word: str) -> Column:
    """Whether a normalised text holds a word at a word start, or anywhere if it has a CJK character."""
    return F.contains(text, F.lit(word)) if re.search(CJK, word) else prefix_count(text, word, 1) > 0


def adjacent_pairs(text: Column, words: list[str], cap: int = 3) -> Column:
    """Word-start occurrences of neighbouring query words side by side, ``cap`` at most in all."""
    total = F.lit(0)
    for a, b in zip(words, words[1:], strict=False):
        total = total + prefix_count(text, f"{a} {b}", cap)
    return F.least(total, F.lit(cap)).cast("int")


def literal_pattern(literal: str) -> str:
    """The regular expression of a quoted phrase: white-space runs match any, and case counts only if
    the phrase has a capital."""
    body = r"\s+".join(_quote(w) if w else "" for w in re.split(r"\s+", literal))
    return ("(?U)" if any(c.isupper() for c in literal) else "(?iuU)") + body


def has_literal(text: Column, literal: str) -> Column:
    return text.rlike(literal_pattern(literal))


def literal_count(text: Column, literal: str) -> Column:
    return F.regexp_count(text, F.lit(literal_pattern(literal)))


def word_share(text: Column, words: list[str]) -> Column:
    """The share of query words, repeats counted, that the lower-case text holds anywhere."""
    low = F.lower(text)
    hits = sum((F.contains(low, F.lit(w.lower())).cast("int") for w in words), F.lit(0))
    return (hits / F.lit(max(len(words), 1))).cast("double")


def matched_terms(text: Column, words: list[str]) -> Column:
    """The distinct query words that the normalised text holds at a word start (anywhere if CJK)."""
    low = normalize(text)
    distinct = list(dict.fromkeys(words))
    tests = [F.when(has_word(low, w), w) for w in distinct]
    return F.array_compact(F.array(*tests)) if tests else F.array().cast("array<string>")


def shorten(text: Column, most: int = 160) -> Column:
    """Clean text in one line, ``most`` characters of it."""
    return F.left(collapse(sanitize(text)), F.lit(most))


def around(body: Column, first: Column, last: Column, before: int = 41, after: int = 80) -> Column:
    """Clean text around the bytes first .. last - 1 of a body."""
    raw = body.cast("binary")
    cut = lambda a, n: F.substring(raw, a, n).cast("string")
    return shorten(F.concat(F.right(cut(F.lit(1), first), F.lit(before)), cut(first + 1, last - first), F.left(cut(last + 1, F.octet_length(body) - last), F.lit(after))))


def head_tail(text: Column, most: int = 16_384) -> Column:
    """Three quarters of ``most`` characters from the start and a quarter from the end of a longer text."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.left(text, F.lit(most * 3 // 4)), F.right(text, F.lit(most // 4))))


def project_name(path: Column) -> Column:
    """The last part of a path; repository/worktree for a worktree."""
    tree = r"([^/]+?)(?:__worktrees/|/\.worktrees/)([^/]+)"
    return F.when(path.rlike(tree), F.concat_ws("/", F.regexp_extract(path, tree, 1), F.regexp_extract(path, tree, 2))).otherwise(F.regexp_extract(path, r"([^/]*)/*$", 1))


def duration_text(seconds: Column) -> Column:
    """1h 4m, 4m 5s or 5s; null if negative."""
    h, m, s = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), F.floor(seconds % 60)
    return F.when(seconds.isNull() | (seconds < 0), None).when(h > 0, F.format_string("%dh %dm", h, m)).when(m > 0, F.format_string("%dm %ds", m, s)).otherwise(F.format_string("%ds", s))


def short_duration(millis: Column) -> Column:
    """0.25s below a second, 4.2s below ten, else as ``duration_text``; null if negative."""
    seconds = millis / 1000
    return F.when(millis.isNull() | (millis < 0), None).when(millis < 10_000, F.concat(F.regexp_replace(F.format_string("%.2f", seconds.cast("double")), r"\.?0+$", ""), F.lit("s"))).otherwise(duration_text(F.floor(seconds)))


def path_below(path: Column, root: str) -> Column:
    """The part of a path below a folder; the path itself if it isn't below it."""
    base = root.rstrip("/") + "/"
    return F.when(path.startswith(base), F.substr(path, F.lit(len(base) + 1))).otherwise(path)
