"""Planning, text expressions and operators of the conversation search."""

from datetime import UTC, datetime
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from parlance.functions import text as T
from parlance.operators import lexical, links, semantic, sessions
from parlance.plans import query as Q

NOW = datetime(2026, 3, 31, 12, tzinfo=UTC)


@pytest.mark.parametrize(
    ("text", "words", "literals", "quoted_only"),
    [
        ("foo bar", ("foo", "bar"), (), False), ('"Foo  bar"', (), ("Foo  bar",), True), ('a "b c" d', ("a", "d"), ("b c",), False), ('x "open end', ("x",), ("open end",), False),
        ('""  ', (), (), False), ("my_name Foo-Bar", ("foo", "bar"), ("my_name",), False),
    ],
)
def test_query_parsing(text, words, literals, quoted_only):
    query = Q.parse_query(text)
    assert (query.words, query.literals, query.quoted_only) == (words, literals, quoted_only)


def test_modes_and_depths():
    assert Q.resolve_mode("hybrid", None, Q.parse_query("a"), 3) == "lexical"
    assert Q.resolve_mode("semantic", None, Q.parse_query('"a"')) == "exact"
    assert [Q.shortlist(n) for n in (1, 20, 1000)] == [50, 100, 500]
    assert Q.exact_query('say "hi" now').literals == ("say hi now",)


@pytest.mark.parametrize(
    ("text", "upper", "want"),
    [
        ("2026-03-01", False, datetime(2026, 3, 1, tzinfo=UTC)), ("2026-03-01", True, datetime(2026, 3, 1, 23, 59, 59, 999999, tzinfo=UTC)), ("1mo", False, datetime(2026, 2, 28, 12, tzinfo=UTC)),
        ("1w2d", False, datetime(2026, 3, 22, 12, tzinfo=UTC)), ("2026-03-01T10:05", True, datetime(2026, 3, 1, 10, 5, 59, 999999, tzinfo=UTC)), ("2026-03-01T10:05:00+00:00", False, datetime(2026, 3, 1, 10, 5, tzinfo=UTC)),
    ],
)
def test_times(text, upper, want):
    assert Q.parse_time(text, NOW, upper) == want


def test_times_in_zones():
    zone = ZoneInfo("Europe/Berlin")
    at = lambda text, upper=False: Q.parse_time(text, NOW, upper, zone).astimezone(UTC)
    assert at("2026-07-01") == datetime(2026, 6, 30, 22, tzinfo=UTC) and at("2026-03-28", True) == datetime(2026, 3, 28, 22, 59, 59, 999999, tzinfo=UTC)
    assert at("2026-03-29T02:30") == datetime(2026, 3, 29, 1, 30, tzinfo=UTC)  # skipped
    assert at("2026-10-25T02:30") == datetime(2026, 10, 25, 0, 30, tzinfo=UTC) and at("2026-10-25T02:30:00", True) > datetime(2026, 10, 25, 1, 30, tzinfo=UTC)  # twice


def test_refs():
    assert (Q.parse_ref("m3").first, Q.parse_ref("m2..m5").last, Q.parse_ref("m4.2").call, Q.parse_ref("s1").kind) == (3, 5, 2, "subagent")
    for bad in ("m0", "m5..m2", "x", "m"):
        with pytest.raises(ValueError, match="invalid-ref"):
            Q.parse_ref(bad)
    with pytest.raises(ValueError, match="window"):
        Q.time_filter(NOW, after="2026-03-05", before="2026-03-01")


def test_word_starts(spark):
    rows = spark.createDataFrame([("xa.a.a", "a.a", 0), ("fired red reduce **red**", "red", 3), ("redred", "red", 1), ("", "red", 0), ("été réd red", "red", 1)], "t string, w string, n int")
    for row in rows.collect():
        assert spark.createDataFrame([(row.t,)], "t string").select(T.prefix_count(F.col("t"), row.w)).first()[0] == row.n


def test_literals_and_cleaning(spark):
    row = spark.createDataFrame([("Of\n  The\x1b[31m red\x1b[0m \x07x", "/home/me/repo/.worktrees/fix", 3905)], "t string, p string, s long")
    got = row.select(
        T.has_literal(F.col("t"), "of the"), T.has_literal(F.col("t"), "of The"), T.collapse(T.sanitize(F.col("t"))), T.project_name(F.col("p")), T.duration_text(F.col("s")),
        T.normalize(F.lit("A_b-C/d")), T.contains_cjk(F.lit("x漢")),
    ).first()
    assert tuple(got) == (True, False, "Of The red x", "repo/fix", "1h 5m", "a b c d", True)


def test_durations_and_paths(spark):
    rows = spark.createDataFrame([(250, "/r/a/b"), (4200, "/ra"), (61_000, "/r/"), (-1, "x"), (None, None)], "ms long, p string")
    got = rows.select(T.short_duration(F.col("ms")), T.path_below(F.col("p"), "/r/")).collect()
    assert [tuple(x) for x in got] == [("0.25s", "a/b"), ("4.2s", "/ra"), ("1m 1s", ""), (None, "x"), (None, None)]


def _messages(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, ordinal long, role string, text string, second long")


def test_numbering_joins_replies_and_skips_warmup(spark):
    rows = [(1, 1, "", "assistant", "r0", "early"), (1, 2, "", "user", None, "Warmup"), (1, 3, "", "user", None, "hello"), (1, 4, "", "assistant", "r1", "a"), (1, 5, "", "assistant", "r1", "b"), (1, 6, "x", "user", None, "sub"), (1, 7, "", "user", None, "  "), (1, 8, "", "user", None, "bye")]
    out = sessions.number_messages(spark.createDataFrame(rows, "conv_id long, sequence long, thread string, role string, reply_id string, text string")).orderBy("sequence").collect()
    assert [x.ordinal for x in out] == [None, None, 1, 2, 2, 3, None, 4]
    assert [x.thread_number for x in out] == [0, 0, 0, 0, 0, 1, 0, 0]


def test_ranking_needs_every_word_and_literal(spark):
    rows = [(1, 1, "user", "red fox", 0), (1, 2, "assistant", "the fox", 60), (2, 1, "user", "red", 0), (3, 1, "user", "fox red fox", 0), (4, 1, "user", "fired fox", 0)]
    scores = {x.conv_id: x.score for x in lexical.rank_sessions(_messages(spark, rows), Q.parse_query("red fox"), 10**9).collect()}
    assert set(scores) == {1, 3}
    assert {x.conv_id for x in lexical.rank_sessions(_messages(spark, rows), Q.parse_query('"the fox"'), 10**9).collect()} == {1}
    assert lexical.rank_sessions(_messages(spark, rows).limit(0), Q.parse_query("red"), 0).count() == 0


def test_as_of_is_strictly_before(spark):
    events = spark.createDataFrame([("a", 5, 1), ("a", 7, 2), ("b", 1, 3)], "k string, at long, id long")
    starts = spark.createDataFrame([("a", 5, "x"), ("a", 2, "w"), ("b", 1, "z")], "k string, start long, v string")
    assert {x.id: x.linked for x in links.as_of(events, starts, "k", "at", "start", "v").collect()} == {1: "w", 2: "x", 3: None}


def test_branch_stops_at_cycles_and_roots(spark):
    nodes = spark.createDataFrame([("t", "a", None, 1), ("t", "b", "a", 2), ("t", "c", "a", 3), ("t", "d", "c", 4), ("u", "x", "y", 1), ("u", "y", "x", 2)], "t string, n string, p string, o long")
    out = {}
    for x in links.branch(nodes, "t", "n", "p", "o").orderBy("depth").collect():
        out.setdefault(x.t, []).append(x.n)
    assert out == {"t": ["d", "c", "a"], "u": ["y", "x"]}


def test_vectors(spark):
    rows = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 0, [0.0, 0.0]), (3, 0, [float("nan"), 1.0]), (4, 0, [1.0]), (5, 0, [1.0, 1.0])], "vec_id long, label int, embedding array<float>")
    assert [(x.vec_id, round(x.score, 3)) for x in semantic.nearest(rows, [1.0, 0.0], 9).collect()] == [(1, 1.0), (5, 0.707), (2, 0.0)]


def test_clean_turns(spark):
    rows = spark.createDataFrame([("a ```x``` b",), ("/help",), ("<system-reminder>no</system-reminder> yes",), ("```open",)], "t string")
    assert [x[0] for x in rows.select(semantic.clean_turn(F.col("t"))).collect()] == ["a b", None, "yes", None]


def test_engine(spark):
    from parlance.engine import Engine

    rows = [(1, 1, "user", "red fox", 0), (1, 2, "assistant", "the red fox", 60), (2, 1, "user", "red", 10)]
    engine = Engine(_messages(spark, rows), datetime(2024, 1, 1, tzinfo=UTC))
    assert [x.conv_id for x in engine.sessions().collect()] == [1, 2]
    assert {(x.conv_id, x.ordinal) for x in engine.search("red fox").collect()} == {(1, 1), (1, 2)}
    assert engine.within(2, "red").count() == 1 and engine.read(1, "m2").first().text == "the red fox"
    assert engine.outline(1, 1).count() == 2 and engine.empty_sessions().first().conv_id == 2
    with pytest.raises(ValueError, match="semantic-unavailable"):
        engine.search("red", "semantic")
