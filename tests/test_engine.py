"""The verbs, and operators that SQL can't express against plain readings of their rules."""

import random
import zlib
from datetime import UTC, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance import agent_queries, errors
from parlance.engine import Engine, Scope
from parlance.operators import evidence, lexical, links, parts, scope, semantic
from parlance.plans import budget
from parlance.plans import query as Q

NOW = datetime(2024, 1, 1, tzinfo=UTC)
PARTS = "conv_id long, ordinal long, position long, role string, thread string, kind string, call_id string, tool string, text string"


def _messages(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, ordinal long, role string, text string, second long")


@pytest.fixture(scope="module")
def engine(spark):
    rows = [(1, 1, "user", "red fox\nand more", 0), (1, 2, "assistant", "the red fox", 60), (1, 3, "assistant", "calls", 70), (1, 4, "user", "red fox\nand more", 80), (2, 1, "user", "red", 10)]
    own = [
        (1, 1, 1, "user", "", "text", None, None, "red fox\nand more"), (1, 2, 1, "assistant", "", "text", None, None, "the red fox"), (1, 3, 1, "assistant", "", "tool_use", "c", "Shell", "ls"), (1, 3, 2, "assistant", "", "tool_use", "d", "Read", "/a"),
        (1, 3, 3, "assistant", "", "thinking", None, None, "hidden red"), (1, 4, 1, "user", "", "tool_result", "d", None, "file"), (1, 4, 2, "user", "a", "text", None, None, "sub says"), (1, 4, 3, "user", "b", "text", None, None, "other says"), (2, 1, 1, "user", "", "text", None, None, "red"),
    ]
    fields = spark.createDataFrame([(1, "zebra talk", "", "proj/tree", "S1", "/w/repo/sub"), (2, "", "", "other", "S2", "/w")], "conv_id long, title string, summary string, project string, session_id string, cwd string")
    found = Engine(_messages(spark, rows), NOW, fields, parts=spark.createDataFrame(own, PARTS))
    made, left = found.build_passages(most=10)
    assert left.first()["left"] == 0
    found.vectors = made
    return found


def test_references(engine):
    assert [x.text for x in engine.read(1, "m2..m3").orderBy("ordinal").collect()] == ["the red fox", "calls"]
    assert {(x.kind, x.text) for x in engine.read(1, "m3.2").collect()} == {("tool_use", "/a"), ("tool_result", "file")}
    assert [x.text for x in engine.read(1, "m3.1").collect()] == ["ls"]
    assert [x.text for x in engine.read(1, "s2").collect()] == ["other says"]
    assert [x.content for x in engine.read(1, "m1", lines=(2, 2)).collect()] == ["and more"]
    assert engine.read(1, "m1", match="AND", context=0).count() == 1
    assert [x.ordinal for x in engine.read(1, tail=2, shown=parts.Shown(tools=False, thinking=False)).orderBy("ordinal").collect()] == [2, 4]
    for ref, error in (("m9", errors.OutOfRange), ("x", errors.InvalidRef), ("s7", errors.NotFound), ("m3.5", errors.NotFound)):
        with pytest.raises(error):
            engine.read(1, ref)
    with pytest.raises(errors.NotFound):
        engine.read(77, "m1")


def test_anchors(engine):
    found = {(x.conv_id, x.ordinal): x.anchor for x in engine.anchors().collect()}
    assert engine.anchor(1, found[1, 2]) == 2
    with pytest.raises(errors.AmbiguousRef):
        engine.anchor(1, found[1, 1])
    with pytest.raises(errors.NotFound):
        engine.anchor(2, found[1, 1])


def test_scopes_and_modes(engine):
    assert [x.conv_id for x in engine.scoped(Scope(["/w/repo"])).sessions().collect()] == [1]
    assert [x.conv_id for x in engine.scoped(Scope(excluded=["proj"])).sessions().collect()] == [2]
    assert [x.conv_id for x in engine.scoped(Scope(running=["S2"])).sessions().collect()] == [1]
    assert {x.conv_id for x in engine.search("zebra").collect()} == set() and {x.conv_id for x in engine.explain_search("zebra").collect()} == {1}
    near = engine.search("the red fox", "semantic").collect()
    assert near and near[0].conv_id == 1 and near[0].fused == pytest.approx(1 / 61)
    both = engine.search("red fox", "hybrid").collect()
    assert {x.hit_kind for x in both} <= {semantic.LEXICAL, semantic.HYBRID, semantic.SEMANTIC} and both[0].conv_id == 1
    assert engine.within(1, "red", mode="semantic").count() == 1
    assert [x.matched for x in engine.coverage("red").collect()] == [2]
    assert engine.read_within_budget(1, "m1..m4", 400, focus=2)[1] == (2, "the red fox")
    with pytest.raises(errors.BudgetTooSmall):
        engine.read_within_budget(1, "m1", 20)
    with pytest.raises(errors.SemanticUnavailable):
        Engine(engine.messages, NOW).search("red", "semantic")
    assert engine.outline(1).count() == 4
    rows = engine.messages.select("conv_id", "ordinal", F.length("text").alias("size")).where("conv_id = 1")
    assert [x.ordinal for x in engine.fitting(rows, "size", ["ordinal"], 30).orderBy("ordinal").collect()] == [1, 2]
    bad = rows.select(F.lit("f").alias("path"), "ordinal")
    assert [(x.kind, x.n, x.ref) for x in engine.warnings(bad).collect()] == [("malformed-transcript", 4, "f")]


def test_words_in_titles_rank(spark):
    messages = _messages(spark, [(1, 1, "user", "fox", 0), (2, 1, "user", "zebra fox", 0), (3, 1, "user", "x", 0)])
    fields = spark.createDataFrame([(1, "Zebra", "", "p"), (2, "", "", "p"), (3, "", "the fox", "zebra-land")], "conv_id long, title string, summary string, project string")
    got = {x.conv_id: x.score for x in lexical.rank_sessions(messages, Q.parse_query("zebra fox"), 0, fields=fields).collect()}
    assert set(got) == {1, 2, 3} and got[1] > got[2]
    window = Q.TimeFilter(datetime(1970, 1, 1, tzinfo=UTC))
    assert {x.conv_id for x in lexical.rank_sessions(messages, Q.parse_query("zebra fox"), 0, window, fields).collect()} == {2}


def test_cjk_words_may_stand_anywhere(spark):
    messages = _messages(spark, [(1, 1, "user", "日本語", 0), (2, 1, "user", "本の話", 0), (3, 1, "user", "犬", 0)])
    got = {x.conv_id: round(x.score, 6) for x in lexical.rank_sessions(messages, Q.parse_query("本"), 0).collect()}
    assert got == {1: 2.5, 2: round(2 + np.log(2), 6)}


def test_splices(spark):
    rows = lambda x: spark.createDataFrame(x, "k string, o long, t long")
    got = links.splice(rows([("a", 1, 50), ("a", 2, 10), ("a", 3, 60)]), rows([("a", 4, 20)]), "k", "o", "t").orderBy("place")
    assert [(x.o, x.origin) for x in got.collect()] == [(4, "child"), (1, "parent"), (2, "parent"), (3, "parent")]
    r = random.Random(1)
    for _ in range(5):
        parents = [("a", i, r.choice([None, *range(8)])) for i in range(r.randrange(8))]
        children = [("a", 100 + i, r.choice([None, *range(9)])) for i in range(r.randrange(1, 6))]
        last, timed = None, []
        for _, o, t in children:
            last = t if t is not None else last
            timed.append((last, o))
        want = [o for _, o, _ in parents]
        for t, o in sorted(timed, key=lambda x: (x[0] is None, x[0] or 0, x[1])):
            at = next((want.index(p) for _, p, pt in parents if t is not None and pt is not None and pt > t), len(want))
            want.insert(at, o)
        got = links.splice(rows(parents), rows(children), "k", "o", "t").orderBy("place").collect()
        assert [x.o for x in got] == want


def test_long_branches(spark):
    nodes = spark.createDataFrame([("t", i, i - 1 if i else None) for i in range(300)], "t string, n long, p long")
    got = {x.n: x.depth for x in links.branch(nodes, "t", "n", "p", "n").collect()}
    assert got == {i: 299 - i for i in range(300)}


def test_calls_link_once(spark):
    calls = spark.createDataFrame([("s", "a"), ("s", "b"), ("s", "b"), ("s", "unknown"), ("s", "c"), ("s", "c#2"), ("t", "a")], "k string, id string")
    results = spark.createDataFrame([("s", "a"), ("s", "b"), ("s", "unknown"), ("s", "c#2"), ("s", None), ("u", "a")], "k string, id string")
    assert {(x.k, x.id): x.linked for x in links.link_calls(calls, results, ["k"], "id").collect()} == {("s", "a"): True, ("s", "b"): False, ("s", "unknown"): False, ("s", "c#2"): True, ("s", None): False, ("u", "a"): False}


def test_passages_equal_a_plain_reading(spark):
    r = random.Random(3)
    turns = [(c, o, "".join(r.choice("ab é 漢 ") for _ in range(r.choice([0, 5, 40, 200])))) for c in range(6) for o in range(1, 14)]
    turns.append((9, 1, "漢字" * 400))

    def plain(rows, size, overlap):
        made, texts, span = [], [], []
        for i, (o, t) in enumerate(rows):
            t = t.strip()
            raw = t.encode()
            if not raw:
                continue
            if len(raw) > size:
                made += [("\n\n".join(texts), span)] if texts else []
                texts, span = [], []
                while raw:
                    end = min(size, len(raw))
                    while end < len(raw) and raw[end] & 0xC0 == 0x80:
                        end -= 1
                    made.append((raw[:end].decode(), [o]))
                    if end == len(raw):
                        break
                    start = end - overlap
                    while raw[start] & 0xC0 == 0x80:
                        start -= 1
                    raw = raw[start:].decode().lstrip().encode()
                continue
            if texts and len("\n\n".join([*texts, t]).encode()) > size:
                made.append(("\n\n".join(texts), span))
                b = rows[i - 1][1].strip()
                texts, span = ([b], [rows[i - 1][0]]) if b and len(b.encode()) <= overlap else ([], [])
            texts.append(t)
            span = [*span, o]
        return made + ([("\n\n".join(texts), span)] if texts else [])

    got = sorted((x.conv_id, x.chunk, x.first, x.last, x.text) for x in semantic.passages(spark.createDataFrame(turns, "conv_id long, ordinal long, text string"), 120, 30).collect())
    want = []
    for c in sorted({t[0] for t in turns}):
        for k, (text, span) in enumerate(plain([(o, t) for d, o, t in turns if d == c], 120, 30)):
            if text.split():
                want.append((c, k, min(span), max(span), " ".join(text.split())))
    assert got == sorted(want) and len(got) > 30


def test_embedding_is_checked_by_batch(spark):
    rows = spark.createDataFrame([(f"k{i}", "bad" if i == 9 else f"word {i}") for i in range(20)], "key string, text string").coalesce(1)

    def some(texts):
        out = semantic.hashed_vectors(texts)
        return out * np.inf if "bad" in texts else out

    got = {x.key: x.embedding for x in semantic.embed(rows, some).collect()}
    assert len(got) == 12 and "k9" not in got
    want = np.zeros(64)
    for w in ("word", "3"):
        h = zlib.crc32(w.encode())
        want[h % 64] += 1 if h >> 31 else -1
    assert got["k3"] == list(want)


def test_context_of_hits(spark):
    query = Q.parse_query('alpha beta "of  the"')
    text = "alpha " + "x " * 60 + "beta alpha " + "y " * 150 + "part Of\nthe whole, alphabet"
    specs = evidence.spec_patterns(query)
    ranges = evidence.context_ranges(text, "alpha beta", specs)
    assert [text.encode()[a:b].decode() for a, b in ranges] == ["Of\nthe whole, alpha"]
    assert evidence.context_ranges("alpha beta of the", "alpha beta of the", specs) == [] and evidence.context_ranges("none", "", specs) == []
    many = ("alpha " + "z" * 300 + " ") * 5
    assert len(evidence.context_ranges(many, "", specs[:1])) == 3
    row = evidence.context_lines(spark.createDataFrame([(1, text, "alpha beta"), (2, None, None)], "conv_id long, text string, preview string"), query, columns=60).orderBy("conv_id").collect()
    assert "Of the whole" in row[0].snippet and row[0].snippet.startswith("…") and evidence.width(row[0].snippet) <= 60 and row[1].snippet == ""
    assert evidence.fitted("漢字漢字", 5) == "漢字…"


def test_refreshed_index(spark):
    index = spark.createDataFrame([(1, 0, "old"), (1, 1, "old"), (2, 0, "kept")], "conv_id long, chunk long, text string")
    made = spark.createDataFrame([(1, 0, "new"), (2, 0, "not asked"), (3, 0, "new")], "conv_id long, chunk long, text string")
    got = semantic.refreshed(index, made, spark.createDataFrame([(1,), (3,), (3,)], "conv_id long"))
    assert sorted(tuple(x) for x in got.collect()) == [(1, 0, "new"), (2, 0, "kept"), (3, 0, "new")]


def test_budgets():
    assert budget.cut_to_budget([5, 5, 5], 11, 1) == 2 and budget.keep_tail([5, 5, 5], 11) == 1
    assert budget.full_budget([50, 45], lambda n: 3 + len(str(n))) == 101
    assert budget.grow_around([5, 5, 5, 50, 5], 16, 1) == [0, 1, 2] and budget.grow_around([90], 10) == [0] and budget.grow_around([], 10) == []
    assert budget.fair_shares([10, 500, 3000], 1000) == [10, 495, 495] and budget.fair_shares([300, 300], 100) == [50, 50] and sum(budget.fair_shares([250, 260, 900], 1200)) == 1200
    assert budget.enough([False, True, True, True], 2) == 3 and budget.enough([False], 1) == 1


def test_ids_and_roots(spark):
    rows = spark.createDataFrame([("ABCDEF01-0000-0000-0000-000000000001",), ("Ses_X",)], "session_id string")
    assert scope.session_query(rows, "abcdef01-0000-0000-0000-000000000001").count() == 1
    assert scope.session_query(rows, "ses_x").count() == 0 and scope.session_query(rows, "two words") is None
    assert scope.resolve_root("a", {"A_HOME": " "}, "A_HOME", "/conf/", "/x") == "/conf" and scope.resolve_root("a", {"A_HOME": "/e"}, "A_HOME", "/conf", "/x") == "/e"
    with pytest.raises(ValueError, match="no folder"):
        scope.resolve_root("a", {}, "A_HOME", None, "")


def test_first_of_several_rows_of_one_provider(spark, tmp_path):
    ids = [40 * 1009 * k + i for k in (2, 1, 0) for i in range(300)]  # file and provider recur after 40 * 1009 ids
    spark.createDataFrame([(i, "", "en") for i in ids], "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = agent_queries.first_provider(spark, str(tmp_path)).collect()
    assert len(got) == 40 and dict(map(tuple, got)) == {f: min((i for i in ids if i % 40 == f), key=lambda i: (i * 7 % 1009, i)) for f in range(40)}
