"""Row-wise operators: chat format, language, secrets, HTML, classifier, quality rules."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from llm_cases import documents, frame, prose
from tersefold.llm import chat_format, html_blocks, html_extraction, language_id, quality_classifier, quality_rules, secret_scan
from tersefold.llm.html_blocks import blocks
from tersefold.llm.html_training import MARK, labelled_pages

TABLES = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"


# Chat format.

def events(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, msg_id long, seq long, kind string, role string, text string")


def test_events_fold_to_final_messages(spark):
    log = events(spark, [
        (1, 1, 1, "message", "user", "draft"), (1, 1, 5, "edit", None, "asked"),
        (1, 2, 2, "message", "assistant", ""), (1, 2, 3, "delta", None, "wro"), (1, 2, 4, "delta", None, "ng"),
        (1, 2, 6, "regenerate", None, None), (1, 2, 7, "delta", None, "ri"), (1, 2, 8, "delta", None, "ght"),
        (2, 9, None, None, None, "orphan"), (2, 9, 1, "delta", "user", "!"),
    ])
    got = {(r.conv_id, r.msg_id): (r.seq, r.role, r.text) for r in chat_format.fold_events(log).collect()}
    assert got == {(1, 1): (1, "user", "asked"), (1, 2): (2, "assistant", "right"), (2, 9): (None, "user", "orphan!")}


@pytest.mark.parametrize("seed", range(3))
def test_rendering_is_reversible(spark, seed):
    r = random.Random(seed)
    bits = ["\\", "#", "##", "###", "<", "</turn>", "</turn>\n", ": ", "\\h", "\\e", "\\c", "\n", "é", "x", "### user: ", ""]
    rows = [(c, t, r.choice(["user", "assistant", "a: b", "", "\\c#"]), "".join(r.choice(bits) for _ in range(r.randint(0, 8))))
            for c in range(20) for t in range(r.randint(1, 5))]
    done = chat_format.render(spark.createDataFrame(rows, "conv_id long, seq long, role string, text string"))
    want = {}
    for c, _, role, text in sorted(rows):
        want.setdefault(c, []).append((role, text))
    for row in done.withColumn("turns", chat_format.read_back(F.col("formatted"))).collect():
        assert [tuple(t) for t in row.turns] == want[row.conv_id]
        assert "".join(s.text for s in row.segments) == row.formatted
        assert sum(s.loss for s in row.segments) == sum(role == "assistant" for role, _ in want[row.conv_id])


def test_turns_keep_repeated_rows_and_nulls(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None), (None, 1, "assistant", "x" * 300_000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("seq", F.lit("clash"))
    done = chat_format.render(chat_format.fold_events(chat_format.turn_events(turns)))
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in done.withColumn(
        "turns", chat_format.read_back(F.col("formatted"))).collect()}
    assert got == {1: [("", ""), ("user", "a"), ("user", "a")], None: [("assistant", "x" * 300_000)]}
    assert chat_format.render(chat_format.fold_events(chat_format.turn_events(turns.limit(0)))).count() == 0


def test_conversations_read_back(spark):
    got = {r.conv_id: r for r in chat_format.op2_chat_format(spark, TABLES).collect()}
    want = {-7: [("user", chat_format.TEST_TEXT), ("assistant", chat_format.TEST_TEXT)]}
    for r in spark.read.parquet(f"{TABLES}/conversations.parquet").orderBy("conv_id", "turn").collect():
        want.setdefault(r.conv_id, []).append((r.role or "", r.text or ""))
    assert got.keys() == want.keys()
    for c, turns in want.items():
        said = "".join(f"{role}\n{text}\n" for role, text in turns)
        loss = "".join(text for role, text in turns if role == "assistant")
        assert (got[c].n_turns, got[c].loss_chars) == (len(turns), len(loss))
        assert got[c].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


# Language.

def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.languages(docs).join(docs, "doc_id").filter("held_out").select(
        (F.col("lang") == F.col("lang_pred")).cast("int").alias("right")).agg(F.avg("right")).first()[0]
    assert got > 0.97


def test_language_of_odd_rows(spark):
    docs = frame(spark, documents())
    got = language_id.languages(docs, per_language=50).collect()
    assert len(got) == docs.count()
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (100, 101, 102))
    assert all(r.lang_pred in ("en", "de") and 0 <= r.score <= 1 for r in got if r.doc_id not in (None, 100, 101, 102))
    assert len({(r.lang_pred, r.score) for r in got if r.doc_id == 105}) == 1
    assert language_id.languages(docs.limit(0)).count() == 0
    blind = language_id.languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in blind} == {"und"}


def test_language_segments_cover_every_byte():
    import pyarrow as pa

    texts = ["", "a" * 63, "é" * 100, "b" * 64, "c" * 1000]
    x, mask, owner = language_id.segments(pa.array(texts))
    for i, text in enumerate(texts):
        rows = [k for k in range(len(owner)) if owner[k] == i]
        assert b"".join(bytes(x[mask[:, k] > 0, k]) for k in rows) == text.encode()


# Secrets.

def spans_by_expression(text):
    text, out = text or "", []
    for m in re.finditer(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        out += [(m.start(), 0, m.end())] if len(m[1]) >= 12 else []
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in sorted(out))


def test_secrets_equal_plain_expressions(spark):
    r = random.Random(5)
    bits = ["password", "PassWd", "secret", "token=", "api_key", "APIKEY", "AKIA", "=", ": ", "'", '"', " ", "abcdef0123456789",
            "Zz9+/_.-", "ABCDEF0123456789", "é", "漢", "\n", "deadbeef", "x"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 40))) for _ in range(400)]
    texts += [None, "", "deadbeef" * 20_000, "token=" * 3000 + "abc", prose(1, 20_000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("spans", F.lit("clash"))
    for row in secret_scan.find_secrets(docs).collect():
        base = ",".join(f"{s.kind}:{s.start}:{s.end}" for s in row.spans if s.kind in secret_scan.BASE_KINDS)
        assert base == spans_by_expression(texts[row.doc_id]), texts[row.doc_id]


def test_secrets_of_the_table(spark):
    texts = dict(spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "text").collect())
    got = secret_scan.op7_secret_scan(spark, TABLES).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.base_sha256 == hashlib.sha256(spans_by_expression(texts[r.doc_id]).encode()).hexdigest()


def test_checksums_decide(spark):
    payload = b"XYZ3456789ghijABCDEFGHIJghijkl"
    good = payload.decode() + secret_scan.base62_crc(payload)
    bad = good[:-1] + ("0" if good[-1] != "0" else "1")
    docs = spark.createDataFrame([(1, f"é ghp_{good} npm_{good}"), (2, f"ghp_{bad} npm_{good}x")], "doc_id long, text string")
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in secret_scan.find_secrets(docs).collect()}
    assert got == {1: [("github", 2, 42), ("npm", 43, 83)], 2: []}
    assert secret_scan.find_secrets(docs.limit(0)).count() == 0


# HTML.

def test_field_on_new_labelled_pages():
    model, right, total = html_extraction.fit(labelled_pages(300, 1)), 0, 0
    for page in labelled_pages(100, 2):
        found = blocks(page)
        want = [int(MARK in b.text) for b in found]
        for b in found:
            b.text = b.text.replace(MARK, "").strip() or "-"
        right += sum(a == b for a, b in zip(model.decode(found), want, strict=True))
        total += len(want)
    assert right / total > 0.98


def test_article_of_given_pages(spark):
    import html

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{TABLES}/pages.parquet").collect()}
    for r in html_extraction.op8_html_extraction(spark, TABLES).collect():
        article = pages[r.page_id].split("<article>")[1].split("</article>")[0]
        parts = (" ".join(html.unescape(re.sub("<[^>]*>", "", p)).split()) for p in re.split(r"</?(?:p|h1)>", article))
        assert r.text == "\n".join(p for p in parts if p)
        assert r.n_chars == len(r.text)


def test_odd_pages(spark):
    odd = [None, "", "<", "<div", "<p>" * 5000 + "x", "<!-- open", "<script>var x='</p>'", "a &amp b &#233; &nosuch; c",
           "<article><p>It was late.<p>He  left\n early.</article", "<a href='x>broken", "</div></p>text", "<svg><p>no</svg>"]
    rows = [(i, None, h) for i, h in enumerate(odd)] + [(0, None, None), (None, "u", "<p>x</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = html_extraction.extract(pages).collect()
    assert len(got) == len(rows)
    assert {r.page_id: r.text for r in got}[8] == "It was late.\nHe left early."
    assert html_extraction.extract(pages.limit(0)).count() == 0


def test_blocks_decode_and_fold():
    got = [b.text for b in blocks("<title>t</title><h1>A&nbsp;&amp; B</h1><p>one<b> two</b><br>three<p>four<ul><li>x<li>y</ul>z")]
    assert got == ["A & B", "one two three", "four", "x", "y", "z"]


@pytest.mark.parametrize("icon", ["<svg/>", "<svg class='a>b' />", '<SVG width="1"\n/>'])
def test_self_closed_svg_holds_nothing(icon):
    assert [b.text for b in blocks(f"<p>one {icon}two<p>three<svg><g/>no</svg> four")] == ["one two", "three four"]
    assert [b.text for b in blocks(f"<p>one</p>{icon}<p>two</p>")] == ["one", "two"]


def plain_blocks(page):
    """Texts and all elements around them by going through the whole stack each time."""
    hb = html_blocks
    out, stack, text, links, linked, path = [], [], [], 0, 0, ()

    def flush():
        nonlocal linked
        joined = " ".join("".join(text).split())
        if joined:
            out.append((joined, path, linked))
        text.clear()
        linked = 0

    def say(raw):
        nonlocal linked, path
        if raw:
            if not "".join(text).strip():
                path = tuple(e for e in stack if e[0] not in hb.INLINE)
            text.append(raw)
            linked += len(raw.strip()) * (links > 0)

    at = 0
    for m in re.finditer(r"<(/?)([a-z0-9]+)([^>]*)>", page):
        say(page[at: m.start()])
        at, tag = m.end(), m[2]
        if tag not in hb.INLINE:
            flush()
        scan = range(len(stack) - 1, -1, -1)
        cut = None
        if m[1]:
            for k in scan:
                if stack[k][0] == tag:
                    cut = k
                    break
                if tag in hb.INLINE and stack[k][0] not in hb.INLINE:
                    break
        else:
            if tag == "br":
                text.append(" ")
            for k in scan:
                if tag in hb.CLOSED_BY.get(stack[k][0], ()):
                    cut = k
                    break
                if stack[k][0] in hb.SCOPES or tag in hb.INLINE:
                    break
        if cut is not None:
            links -= sum(e[0] == "a" for e in stack[cut:])
            del stack[cut:]
        if not m[1] and tag not in hb.VOID:
            stack.append((tag, hb._attr_words(m[3])))
            links += tag == "a"
    say(page[at:])
    flush()
    return out


def test_blocks_equal_a_plain_reading():
    rng = random.Random(7)
    tags = "p div b i a li ul td tr table section main h1 br hr nav option span".split()
    for _ in range(400):
        page = ""
        for _ in range(rng.randint(0, 60)):
            tag, roll = rng.choice(tags[: rng.randint(3, len(tags))]), rng.random()
            page += f"<{tag}{rng.choice(['', ' class=side', ' id=mainMenu class=x'])}>" if roll < 0.4 else f"</{tag}>" if roll < 0.7 else rng.choice(["x ", " ", "some words"])
        got = blocks(page)
        want = plain_blocks(page)
        assert [(b.text, b.link_chars) for b in got] == [(t, n) for t, _, n in want]
        for b, (_, path, _) in zip(got, want, strict=True):
            words = [w for _, ws in path for w in ws]
            sections = [t for t, _ in path if t in html_blocks.SECTIONS]
            assert sorted(html_extraction._path_features(b.place)) == sorted([
                *{f"in {t}" for t, _ in path}, *{f"named {w}" for w in words}, "parent " + (path[-1][0] if path else ""),
                "sections " + ">".join(sections[-2:]), "innermost " + (sections[-1] if sections else ""),
                *[f"nearest {w}" for w in next((ws for _, ws in reversed(path) if ws), ())]])


@pytest.mark.parametrize("page", [
    "<p>" + "<b>x</b>" * 40_000, "<div class='a b'>x" * 100_000, "x</i></section></p>" * 100_000, "<b>" * 50_000 + "</i>x<p>y</p>" * 50_000,
    "<a>x" * 50_000 + "</a>" * 50_000], ids=["inline", "nested", "ends", "open", "links"])
def test_large_pages_take_linear_time_and_memory(page):
    import time
    import tracemalloc

    model = html_extraction.Field({"in div": (0.1, 0.2)}, [[0.0, 0.0], [0.0, 0.0]], [0.0, 0.0])
    start = time.process_time()
    html_extraction.main_text(model, page)
    assert time.process_time() - start < 4
    tracemalloc.start()
    html_extraction.main_text(model, page[: len(page) // 2])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6


def test_decoding_and_marginals_equal_all_labelings():
    import itertools

    import numpy as np

    rng = np.random.default_rng(2)
    for n in range(1, 7):
        e, steps, start = rng.normal(size=(1, n, 2)), rng.normal(size=(2, 2)), rng.normal(size=2)
        score = {y: start[y[0]] + sum(e[0, t, y[t]] for t in range(n)) + sum(steps[a, b] for a, b in zip(y, y[1:]))
                 for y in itertools.product((0, 1), repeat=n)}
        model = html_extraction.Field(
            {f"length {t + 1}": tuple(e[0, t]) for t in range(n)}, steps.tolist(), start.tolist())
        page = [html_blocks.Block("x" * (1 << t), None, 0) for t in range(n)]
        assert tuple(model.decode(page)) == max(score, key=score.get)
        total = sum(np.exp(s) for s in score.values())
        node, pair = html_extraction._marginals(e, np.ones((1, n), dtype=bool), steps, start)
        for t, k in itertools.product(range(n), (0, 1)):
            assert node[0, t, k] == pytest.approx(sum(np.exp(s) for y, s in score.items() if y[t] == k) / total)
        for a, b in itertools.product((0, 1), repeat=2):
            want = sum(np.exp(s) * sum((u, v) == (a, b) for u, v in zip(y, y[1:])) for y, s in score.items()) / total
            assert pair[a, b] == pytest.approx(want)


# Samples.

def test_samples_are_bounded_whatever_repeats(spark):
    """One id, null ids, and one row that is nearly all rows."""
    rows = [(None, prose(f"n{i}", 30), "en") for i in range(400)] + [(5, prose(f"f{i}", 30), "de") for i in range(400)]
    rows += [(9, prose("again", 30), "fr")] * 2000 + [(10 + i, prose(f"r{i}", 30), "fr") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(6)
    texts, langs = language_id._sample(docs, 20)
    for lang, n in Counter(langs).items():
        assert n <= 20 * language_id.WINDOWS
        # Different documents, as many as there are in the learning part.
        assert len({t for t, x in zip(texts, langs) if x == lang}) > 10 or lang == "fr"
    labels = spark.createDataFrame([(5, 1), (9, 0), *[(10 + i, i % 2) for i in range(40)], (None, 1)], "doc_id long, quality int")
    x, y = quality_classifier._sample(docs, labels, 25)
    assert len(y) <= 25 and len({tuple(d) for d in x.dense}) > 10


def test_gradients_of_the_network_equal_differences():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(5)
    layer = lambda: language_id.Direction(*(rng.normal(0, 0.4, shape).astype(np.float64) for shape in (
        (256, 3 * language_id.HIDDEN), (language_id.HIDDEN, 2 * language_id.HIDDEN), (language_id.HIDDEN,) * 2, (language_id.HIDDEN,))))
    net = language_id.Network(["a", "b", "c"], layer(), layer(), rng.normal(size=(2 * language_id.HIDDEN, 3)), rng.normal(size=3))
    x, mask, owner = language_id.segments(pa.array(["ab c1", "bcażz", "cc"]))
    y = np.array([0, 2, 1])[owner]

    def loss():
        p = net.positions(x, mask)
        counted = language_id.LETTER[x] & (mask > 0)
        return -np.log(np.take_along_axis(p, np.broadcast_to(y[None, :, None], (*x.shape, 1)), 2)[:, :, 0])[counted].mean()

    parameters = [*net.forward.parameters(), *net.backward.parameters(), net.output, net.bias]
    for p, grad in zip(parameters, language_id._gradients(net, x, mask, y), strict=True):
        for _ in range(6):
            at = (ord(rng.choice(list("abc"))), rng.integers(p.shape[1])) if p.shape[0] == 256 else tuple(rng.integers(n) for n in p.shape)
            kept, step = p[at], 1e-2
            p[at] = kept + step
            high = loss()
            p[at] = kept - step
            low = loss()
            p[at] = kept
            assert grad[at] == pytest.approx((high - low) / (2 * step), abs=2e-3)


def test_network_equals_a_run_byte_by_byte():
    import numpy as np
    import pyarrow as pa

    net = language_id.fit(["the house and the river", "der fluss und das haus"], ["en", "de"])
    text = "the fluß and haus"
    x, mask, _ = language_id.segments(pa.array([text]))
    sig = lambda v: 1 / (1 + np.exp(-v))
    h, size = language_id.HIDDEN, len(text.encode())

    def states(d, data):
        s, out = np.zeros(h), []
        for byte in data:
            rz = sig(s @ d.gates + d.inputs[byte][: 2 * h])
            c = np.tanh(d.inputs[byte][2 * h:] + rz[:h] * (s @ d.candidate + d.bias))
            s = c + rz[h:] * (s - c)
            out.append(s)
        return out

    data = text.encode()
    both = np.concatenate([states(net.forward, data), states(net.backward, data[::-1])[::-1]], axis=1)
    want = np.exp(both @ net.output + net.bias)
    want /= want.sum(axis=1, keepdims=True)
    assert net.positions(x, mask)[:size, 0] == pytest.approx(want, abs=1e-4)


# Classifier.

def test_quality_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality_classifier.quality_scores(docs, labels).filter("held_out").join(labels, "doc_id").select(
        "quality", "predicted").collect()
    assert sum(r.quality == r.predicted for r in got) / len(got) > 0.97
    assert all(r.predicted for r in got if r.quality)


def test_scores_of_odd_rows(spark):
    docs = frame(spark, documents())
    labels = spark.createDataFrame(
        [(i, i % 2, 0) for i in range(30)] + [(1, 1, 0), (2, None, 0), (None, 1, 0), (999, 0, 0)],
        "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))
    got = quality_classifier.quality_scores(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 105}) == 1
    kept = quality_classifier.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.predicted for r in got)
    assert quality_classifier.quality_scores(docs.limit(0), labels).count() == 0
    flat = quality_classifier.quality_scores(docs, labels.limit(0)).collect()
    assert {r.score for r in flat} == {0.5}


def test_pair_terms_equal_the_sum_over_pairs():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    m = quality_classifier.fit(quality_classifier.features(pa.array(["a b", "c"])), np.array([1.0, 0.0]))
    m.linear, m.factors = (rng.normal(size=a.shape).astype(np.float32) for a in (m.linear, m.factors))
    x = quality_classifier.features(pa.array(["a b c a", "d|e"]))
    row, feature, value = m.rows(x)
    got, _ = m.margin(row, feature, value, 2)
    for k in (0, 1):
        mine = np.flatnonzero(row == k)
        want = m.bias + float(m.linear[feature[mine]] @ value[mine])
        want += sum(float(m.factors[feature[i]] @ m.factors[feature[j]] * value[i] * value[j])
                    for a, i in enumerate(mine) for j in mine[a + 1:])
        assert got[k] == pytest.approx(want, rel=1e-3)


# Quality rules.

def counts_of(text):
    w = re.findall(WORD, text or "")
    seen = Counter(zip(w, w[1:], w[2:]))
    again = {k for i, x in enumerate(zip(w, w[1:], w[2:])) if seen[x] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(WORD, x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again))


def test_counts_equal_a_plain_reading(spark):
    r = random.Random(9)
    texts = ["".join(r.choice(["a", "b ", "c d ", "\n", "\r\n", "\t", "# ", "é ", "\x0b", "<|> ", " "])
                     for _ in range(r.randint(0, 120))) for _ in range(200)]
    texts += [None, "", " ", prose(1, 30_000), "x " * 5000, "a b c a b c\n" * 60]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_words", F.lit("clash"))
    for g in quality_rules.clean_lines(docs).collect():
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == counts_of(texts[g.doc_id])
        assert g.base_failed == (g.n_words < 50 or 100 * g.n_repeat_words > 50 * g.n_words)
        assert not (g.kept and g.base_failed)


def test_bad_lines_go_and_bad_documents_with_them(spark):
    good = prose(7, 80) + "."
    nav, boiler = "Home | News | Sport | About | Contact", "Licensed under some terms, all rights reserved."
    docs = spark.createDataFrame([
        (1, good), (2, f"{nav}\n{good}\n{boiler}"), (3, f"{nav}\n" * 60 + good[:120]), (None, good)], "doc_id long, text string")
    got = {r.doc_id: r for r in quality_rules.clean_lines(docs).collect()}
    assert got[1].kept and got[2].kept and not got[3].kept and got[None].kept
    assert got[2].cleaned == good
    assert quality_rules.clean_lines(docs.limit(0)).count() == 0
