"""Extraction, formatting, line rules, language model, mixing, quality and tokens."""

import collections
import hashlib
import math
import random
import re
import time
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parlance.llm import cotraining, line_frequency, ppm, raking, reply_trees, text_density, wfst

PAGE = """<html><body class="has-sidebar"><div id=top class="site-header">My site</div><div class="menu"><a href=a>One</a> <a href=b>Two</a></div>
<div class=wrap><div class="post"><h1>Title &amp; more</h1><div class=entry><p>First para with enough words to be dense, really quite long &mdash; it is.<p>Second <i>para</i> <a href=x>with link</a> continues here for a while longer.<ul><li>item one here<li>item two here</ul></div></div>
<div class="sidebar"><p>Popular stuff you might like today and tomorrow</p></div><div id="comments"><p>Great post! I really loved it a lot, this is a reader comment of long length.</p></div></div>
<form><p>Sign up now</p><input></form><div>Copyright 2020 all rights</div><script>if(a<b){}</script></body></html>"""


def test_main_text_of_a_page_without_semantic_tags():
    assert text_density.main_text(PAGE).split("\n\n") == [
        "Title & more", "First para with enough words to be dense, really quite long — it is.", "Second para with link continues here for a while longer.", "item one here", "item two here",
    ]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""), (None, ""), ("plain", "plain"), ("<p>a", "a"), ("<article><p>x &am", "x &am"), ("<div><span>hello</span> <b>wor</b>ld<br>next</div>", "hello world next"),
        ("<nav>a</nav>", ""), ("<article><p>cut off<p cla", "cut off"), ("<article><p>a<!-- b --><script>c</script></p><p>d</p></article><footer>e</footer>", "a\n\nd"),
        ("<body><article><h1>T</h1><p>one two</p><div class='comments'><p>me too me too me too</p></div></article></body>", "T\n\none two"),
    ],
)
def test_main_text_cases(page, text):
    assert text_density.main_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article class='post comments-open'><p>one two three</p></article>", "one two three"),
        ("<body><div class='post has-sidebar'><p>one two three</p><p>four five six</p></div></body>", "one two three\n\nfour five six"),
        ("<article><h1>T</h1><p>one two three</p><p class='ad-hoc'>four five</p><section id='related-work'><p>six</p></section></article>", "T\n\none two three\n\nfour five\n\nsix"),
        ("<article><p>one two three four</p><ol class='comment-list'><li><article class='comment'><p>me too</p></article></li></ol></article>", "one two three four"),
        ("<article><p>one two three four</p><article class='comment user'><p>me too</p></article></article>", "one two three four"),
        ("<body><div class='ad-slot'><p>buy this and that now</p></div><div><p>one two</p><p>three</p></div><div id='cookie-notice'><p>we use</p></div></body>", "one two\n\nthree"),
        ("<p>a <b>b</b></p><p>c <a <a <a", "a b\n\nc"),
    ],
)
def test_classes_that_only_sound_like_boilerplate(page, text):
    assert text_density.main_text(page) == text


def test_dense_siblings_under_the_body_stay():
    div = lambda c, n: "<div>" + "".join(f"<p>{c * 200}</p>" for _ in range(n)) + "</div>"
    out = text_density.main_text(f"<body>{div('a', 5)}{div('b', 4)}<div>Copyright 2020</div><div><a href=x>one</a> <a href=y>two</a></div></body>")
    assert out.split("\n\n") == ["a" * 200] * 5 + ["b" * 200] * 4


@pytest.mark.parametrize("page", ["<b>" * 400_000 + "x" + "</i>" * 400_000, "<i><div>" + "<b>" * 300_000 + "</i>" * 300_000, "<a " * 700_000, '<a =">" ' * 400_000, "<div>" * 500_000 + "x", "<p>" * 700_000 + "x"])
def test_hostile_pages_take_little_time(page):
    began = time.process_time()
    text_density.main_text(page)
    assert time.process_time() - began < 20


def _plain_densities(node, whole):
    """(density, sum) of nested lists [tag, children or texts ...] by the definition, bottom up."""
    chars = links = tags = link_tags = 0
    total = 0.0
    for child in node[1:]:
        if isinstance(child, str):
            chars += len(child)
            links += len(child) * (node[0] == "a")
        else:
            density, _, c, lc, t, lt = _plain_densities(child, whole)
            chars, links, tags, link_tags = chars + c, links + (c if node[0] == "a" else lc), tags + t + 1, link_tags + lt + (child[0] == "a")
            total += density
    if not chars:
        return 0.0, total, 0, 0, tags, link_tags
    base = math.log(chars / max(chars - links, 1) * links + whole * chars + math.e)
    ratio = max(chars / max(links, 1) * max(tags, 1) / max(link_tags, 1), 1.0)
    density = chars / max(tags, 1) * (math.log(ratio) / math.log(base) if base > 1.0000001 else math.log(ratio + math.e))
    return density, total, chars, links, tags, link_tags


def test_densities_equal_their_definition():
    r = random.Random(6)

    def tree(depth):
        if depth == 0 or r.random() < 0.2:
            return ["a", "l" * r.randrange(1, 20)]
        return [r.choice(["div", "span", "section"])] + [r.choice(["w" * r.randrange(1, 40), None]) or tree(depth - 1) for _ in range(r.randrange(1, 4))]

    def markup(node):
        return f"<{node[0]}>" + "".join(c if isinstance(c, str) else markup(c) for c in node[1:]) + f"</{node[0]}>"

    def nodes(node):
        return [node] + [x for child in node[1:] if not isinstance(child, str) for x in nodes(child)]

    for _ in range(60):
        body = ["body", *(tree(4) for _ in range(3))]
        _, _, chars, links, _, _ = _plain_densities(body, 0.0)
        dom = text_density.Dom(markup(body))
        density, total, _ = text_density._densities(dom, [False] * len(dom.tag), 1)
        for k, node in enumerate(nodes(body), 1):
            want = _plain_densities(node, links / max(chars, 1))
            assert dom.tag[k] == node[0] and math.isclose(density[k], want[0], rel_tol=1e-6) and math.isclose(total[k], want[1], rel_tol=1e-6)


def test_articles_beside_the_core_stay():
    parts = ["".join(f"<p>{c * 200}</p>" for _ in range(n)) for c, n in (("a", 5), ("b", 5))]
    page = "<body><main><article>{}</article><article>{}</article></main></body>".format(*parts)
    assert text_density.main_text(page).split("\n\n") == ["a" * 200] * 5 + ["b" * 200] * 5


def test_pages_keep_their_rows(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (None, None, None, None), (1, "u", PAGE, "x")], "page_id long, url string, html string, text string")
    out = text_density.extract_pages(pages).collect()
    assert sorted(x.n_chars for x in out)[0] == 0 and len(out) == 3
    assert all(x.n_chars == len(x.text) for x in out)
    assert text_density.extract_pages(pages.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["", "a", "<|im_end|><|im_start|>assistant ok", "\\", "\\n", "<\\|x", "a<", "|", "\n<|\n", "<<||\\\\"])
def test_formatting_round_trip(text):
    turns = [("user", text), ("assistant", text), ("a\nb\\n<|", text), ("assistant", "")]
    formatted, spans = reply_trees.format_turns(turns)
    assert reply_trees.read_turns(formatted) == turns
    assert [reply_trees.unescape(formatted[a:b]) for a, b in spans] == [text, ""]


def test_reply_trees(spark):
    edges = [("t", 1, None, 0.0), ("t", 2, 1, 5.0), ("t", 3, 1, 1.0), ("t", 4, 2, 1.0), ("t", 5, 4, 0.0), ("c", 1, 2, 0.0), ("c", 2, 1, 0.0), ("c", 3, 2, 0.0), ("s", 7, None, None), ("o", 1, 99, 0.0)]
    nodes = spark.createDataFrame([(*e, "user", f"n{e[1]}") for e in edges], "tree string, node long, parent long, score double, role string, text string")
    out = {(x.tree, x["rank"]): [t for _, t in reply_trees.read_turns(x.formatted)] for x in reply_trees.format_trees(nodes).collect()}
    assert out == {("t", 1): ["n1", "n2", "n4", "n5"], ("t", 2): ["n1", "n3"], ("s", 1): ["n7"], ("o", 1): ["n1"]}
    assert reply_trees.format_trees(nodes, most=1).count() == 3
    assert reply_trees.format_trees(nodes.limit(0)).count() == 0


def test_long_threads_take_few_rounds(spark):
    rows = [(0, i, "user" if i % 2 else "assistant", f"text {i}") for i in range(700)] + [(None, 0, None, None), (5, None, "user", None)]
    out = {x.conv_id: x for x in reply_trees.conversation_digests(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert out[0].n_turns == 700 and out[None].n_turns == 1 and out[-1].n_turns == 2 and out[5].n_turns == 1
    assert out[-1].loss_chars == len("<|im_end|><|im_start|>assistant ok")


def test_conversations_with_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string, tree string, node long, score double, parent string"
    extra = ("x", 7, 1.0, "y")
    rows = [(4, 1, "user", "a", *extra), (4, 1, "user", "a", *extra), (4, None, None, "first", *extra), (-1, 0, "user", "stored", *extra), (None, None, None, None, *extra), (None, 3, "assistant", "z", *extra), (5, 2, "assistant", "<|im_end|>\n\\n" * 9000, *extra)]
    out = reply_trees.conversation_digests(spark.createDataFrame(rows, schema)).collect()
    found = sorted((x.conv_id if x.conv_id is not None else 99, x.n_turns, x.loss_chars) for x in out)
    assert found == [(-1, 1, 0), (-1, 2, 34), (4, 3, 0), (5, 1, 12 * 9000 + 9000), (99, 2, 1)]
    digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in (("", "first"), ("user", "a"), ("user", "a"))).encode()).hexdigest()
    assert [x.turns_sha256 for x in out if x.conv_id == 4] == [digest]
    assert [x.conv_id for x in reply_trees.conversation_digests(spark.createDataFrame([], schema)).collect()] == [-1]


def test_line_counts(odd_rows):
    texts = [r[0] or "" for r in odd_rows] + ["a b c a b c a\n\n a b\na b\n"]
    table = pa.table({"doc_id": list(range(len(texts))), "host": [""] * len(texts), "text": texts})
    got = pa.Table.from_batches(list(line_frequency.profile_batches(table.to_batches()))).to_pylist()
    for text, row in zip(texts, got, strict=True):
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        often = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        inside = {i + k for i in range(len(w) - 2) if often[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside))
        assert tuple(row[c] for c in line_frequency._COUNTS) == want


def test_texts_without_frequent_lines(spark, odd, odd_rows):
    rows = [(i, f"own é {i}\n\nShared  LINE\nend {i}", "a") for i in range(6)] + [(9, "shared line\nx", "b"), (None, None, "b")]
    out = line_frequency.remaining_texts(spark.createDataFrame(rows, "doc_id long, text string, source string"), max_docs=4).collect()
    assert {x.doc_id: x.text for x in out} == {i: f"own é {i}\n\nend {i}" for i in range(6)} | {9: "shared line\nx", None: ""}
    assert line_frequency.remaining_texts(odd).count() == len(odd_rows)


def test_frequent_lines_go(spark, odd, odd_rows, nothing):
    own = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n))
    rows = [(i, own(i, 60) + "\nThe  common LINE here", "h") for i in range(6)] + [(10 + i, "The common line here " * 1 + "\n" + own(i, 60), "other") for i in range(2)]
    rows += [(20 + i, own(99, 70), "h") for i in range(9)]  # copies are documents, too
    rows += [(40, own(98, 70), "h")] * 9 + [(41, own(97, 70), "h")] * 2 + [(42 + i, own(97, 70), "h") for i in range(3)]  # rows of a doc_id are one
    out = {x.doc_id: x for x in line_frequency.line_verdicts(spark.createDataFrame(rows, "doc_id long, text string, source string"), max_docs=4).collect()}
    assert all(out[i].removed_chars == len("Thecommonlinehere") and out[i].kept for i in range(6))
    assert all(out[i].removed_chars == 0 for i in (10, 11, 40, 41, 42, 44))
    assert all(out[i].removed_chars == out[i].word_chars > 0 and not out[i].base_failed and not out[i].kept for i in range(20, 29))
    assert line_frequency.line_verdicts(odd).count() == len(odd_rows)
    assert line_frequency.line_verdicts(nothing).count() == 0


def _levels(grams):
    out = []
    for order in range(ppm.ORDER + 1):
        keys, n = np.unique(grams & np.uint64((1 << 8 * (order + 1)) - 1), return_counts=True)
        out.append((keys, n))
    return out


def _plain(levels, gram):
    """log10 of PPM-D's probability, by its definition."""
    out, gone = 0.0, set()
    for order in range(ppm.ORDER, -1, -1):
        context = (gram & ((1 << 8 * (order + 1)) - 1)) >> 8
        after = {int(k) & 255: int(n) for k, n in zip(*levels[order], strict=True) if int(k) >> 8 == context}
        left = {s: n for s, n in after.items() if s not in gone}
        total = sum(left.values())
        if gram & 255 in left:
            return out + math.log10((left[gram & 255] - 0.5) / total)
        if left:
            out += math.log10(len(left) / 2 / total)
        gone |= set(after)
    return out - math.log10(256 - len(gone))


def test_ppm_is_ppm():
    from parlance.llm import kernels

    texts = ["the cat the cat sat on the mat", "a cat", "thé the ÇA va", "xyz"] * 3 + [""]
    grams, _ = ppm.padded(*kernels.buffers(pa.array(texts)))
    levels = _levels(grams)
    model = ppm.Model(levels)
    r = random.Random(0)
    contexts = [int(g) >> 8 for g in grams[::7]] + [int.from_bytes(bytes(r.choice(b"the cat xyz") for _ in range(ppm.ORDER)), "big") for _ in range(20)]
    for context in contexts:
        every = np.array([context << 8 | s for s in range(256)], np.uint64)
        assert math.isclose((10 ** model.score(every)).sum(), 1, rel_tol=1e-9)
        assert all(math.isclose(model.score(every[s : s + 1])[0], _plain(levels, int(every[s])), rel_tol=1e-9) for s in (0, 32, 97, 116, 255))


def test_scores_and_base_model(spark, odd, odd_rows, nothing):
    out = ppm.score_documents(odd).collect()
    rows = [(r[1], "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (r[0] or ""))) for r in odd_rows]
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t) + ["\0"]
    held = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2
    counts = collections.Counter(w for d, t in rows if not held(d) for w in words(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((-1 if d is None else d, held(d), len(words(t)), sum(counts[w] > 0 for w in words(t)), round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words(t)), 6)) for d, t in rows)
    got = sorted((-1 if x.doc_id is None else x.doc_id, x.held_out, x.n_tokens, x.n_known, round(x.base_score, 6)) for x in out)
    assert got == want and {x.train_tokens for x in out} == {n} and all(x.score < 0 for x in out)
    assert ppm.score_documents(nothing).count() == 0


def test_ppm_keeps_all_nodes(spark):
    from parlance.llm import kernels

    r = random.Random(4)
    rows = [(i, "".join(r.choices("abcdefghijklmnopqrst ", k=60_000))) for i in range(30)] + [(100 + i, "kept words " + str(i)) for i in range(20)]
    held = ppm.held_out([d for d, _ in rows])
    levels = _levels(ppm.padded(*kernels.buffers(pa.array([t for (_, t), h in zip(rows, held, strict=True) if not h])))[0])
    assert len(levels[-1][0]) > 1 << 20
    model = ppm.Model(levels)
    want = {d: model.score(ppm.padded(*kernels.buffers(pa.array([t])))[0]).sum() for d, t in rows}
    got = {x.doc_id: x.score for x in ppm.score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[d], want[d], rel_tol=1e-9) for d in want)


def test_ppm_without_training_documents(spark):
    d = next(i for i in range(100) if ppm.held_out([i])[0])
    out = ppm.score_documents(spark.createDataFrame([(d, "abc")], "doc_id long, text string")).collect()
    assert math.isclose(out[0].score, -4 * math.log10(256), rel_tol=1e-9)


def test_raking_reaches_its_margins(spark, odd, odd_rows, nothing):
    r = random.Random(1)
    cells = spark.createDataFrame([(s, l, t, r.randrange(1, 1000)) for s in "abc" for l in "xy" for t in "pq"], "source string, lang string, topic string, tokens long")
    wanted = {m: raking.targets(cells, m, 0.5, 10.0) for m in ("source", "lang", "topic")}
    out = raking.rake(cells, wanted, 30)
    for margin, shares in wanted.items():
        got = {x[0]: x[1] for x in out.groupBy(margin).agg(F.sum(F.col("tokens") * F.col("weight"))).collect()}
        assert all(math.isclose(got[x[0]], x.target, rel_tol=1e-6) for x in shares.collect())
    mixed = raking.mix(odd)
    assert mixed.columns[: len(odd.columns)] == odd.columns and mixed.count() == len(odd_rows)
    assert mixed.where("probability < 0 OR probability > 1").count() == 0
    assert raking.mix(nothing).count() == 0


def test_drawn_mix_reaches_the_targets(spark):
    r = random.Random(3)
    rows = [(i, "w " * r.choice([5, 80, 400]) + r.choice(["", " | ", "%%%"]), r.choice("aaaaab"), r.choice("xxxy")) for i in range(600)]
    rows += [(600 + k, "one rare text", "c", "xy"[k]) for k in range(2)]
    mixed = raking.mix(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"))
    drawn = mixed.collect()
    held = {(x.margin, x.value): x for x in raking.margins(mixed).collect()}
    for margin, power in raking.POWERS.items():
        whole, kept = collections.Counter(), collections.Counter()
        for x in drawn:
            whole[x[f"mix_{margin}"]] += x.n_tokens
            kept[x[f"mix_{margin}"]] += x.n_tokens * x.probability
        total, level = sum(whole.values()), sum(n**power for n in whole.values())
        aim = {k: min(n**power / level, raking.LIFT * n / total) for k, n in whole.items()}
        for k in whole:
            assert math.isclose(held[margin, k].target, aim[k] / sum(aim.values()), rel_tol=1e-9)
            assert math.isclose(kept[k] / sum(kept.values()), aim[k] / sum(aim.values()), rel_tol=1e-6)
    assert max(x.probability for x in drawn) <= 1 and sum(x.n_tokens * x.probability for x in drawn) > 0.2 * sum(x.n_tokens for x in drawn)


def test_mixing_takes_a_topic_column(spark):
    rows = [(i, "w " * (i % 9), "ab"[i % 2], "x", "pqr"[i % 3], i) for i in range(60)]
    mixed = raking.mix(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, topic string, n_chars long")).collect()
    assert {x.mix_topic for x in mixed} == {"p", "q", "r"}


def test_quality_held_out(spark, odd, odd_rows, nothing):
    r = random.Random(2)
    good = lambda: " ".join(r.choice("the river runs past old stone houses and green fields".split()) for _ in range(80)) + "."
    bad = lambda: r.choice([" | ".join(r.choice("abc def ghi".split()) for _ in range(60)), "BUY NOW!! " * 30, " ".join(w + "%%%" for w in good().split())])
    rows = [(i, good() if i % 3 else bad(), "en", "s") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 600, 2)] + [(None, 1), (1, 0), (1, 1), (9999, 1)], "doc_id long, quality int")
    out = cotraining.quality_scores(docs, labels).collect()
    assert sum(x.kept == (x.doc_id % 3 > 0) for x in out if x.doc_id % 2) >= 0.95 * 300
    assert cotraining.keep_good(docs, labels).columns == docs.columns
    assert cotraining.quality_scores(odd, labels.limit(0)).where("score = 1").count() == len(odd_rows)
    assert cotraining.quality_scores(nothing, labels).count() == 0


needs_model = pytest.mark.skipif(not Path(wfst.MODEL).exists(), reason="no vocabulary file")


@needs_model
def test_tokens_equal_the_library(odd_rows):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=wfst.MODEL)
    machine = wfst.Transducer(wfst.read_model())
    texts = ["", "a", " a", "a ", "  two  spaces", "héllo wörld\nnew\tline", "日本語テキスト 漢字", "😀 emoji", "a▁b", "ﬁ ① ½", "x" * 300, "<s> </s> <unk> <0x41>", *(r[0] or "" for r in odd_rows)]
    r = random.Random(0)
    texts += ["".join(r.choice("abcde thing. ÀßØ\n#'\"12") for _ in range(200)) for _ in range(50)]
    for text in texts:
        assert machine.encode(text) == library.encode(text)
        assert machine.decode(machine.encode(text)) == text.replace("▁", " ")


@needs_model
def test_token_rows(odd, odd_rows, nothing):
    out = wfst.round_trips(odd).collect()
    assert len(out) == len(odd_rows) and all(x.exact for x in out)
    assert wfst.encode(odd).agg(F.sum("n_tokens")).first()[0] == sum(x.n_tokens for x in out)
    assert wfst.encode(nothing).count() == 0
