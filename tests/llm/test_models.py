"""Quality model, page labeller, vector search and URL templates."""

from __future__ import annotations

import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedweave.llm import block_labeller, collision_search, hashing, html_blocks, quality_lm, url_templates

from . import samples

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shape(word: str) -> int:
    raw = word.encode()
    lower = sum(c >= 128 or 97 <= c <= 122 for c in raw)
    upper, digit = sum(65 <= c <= 90 for c in raw), sum(48 <= c <= 57 for c in raw)
    symbol = len(raw) - lower - upper - digit
    last = not (raw[-1] >= 128 or chr(raw[-1]).isalnum())
    if lower + upper + digit == 0:
        return 6
    if symbol - last > 0:
        return 7
    if digit:
        return 5
    if not lower and upper > 1:
        return 3
    if 65 <= raw[0] <= 90 and upper == 1:
        return 2
    return 1 if not upper else 4


def brute_perplexity(train, held, texts, vocabulary_size, prior):
    """A plain dictionary version for one language: nats of every text, drawn perplexities."""
    counts = Counter(w for t in train for w in WORD.findall(t))
    known = {w for w, n in counts.items() if n > 1}
    assert len(known) <= vocabulary_size
    name = lambda w: w if w in known else shape(w)
    pair, spelled = Counter(), Counter()
    for t in train:
        found = WORD.findall(t)
        ids = [0, *map(name, found)]
        pair.update(zip(ids[:-1], ids[1:], strict=True))
        for w in found:
            if w not in known:
                raw = b" " + w.encode() + b" "
                spelled.update(zip(raw[:-1], raw[1:], strict=True))
    every = [*range(quality_lm.SHAPES), *sorted(known)]
    total, kinds, before = Counter(), defaultdict(Counter), Counter()
    for (a, b), n in pair.items():
        total[a] += n
        kinds[a][min(n, 3)] += 1
        before[b] += 1
    d = quality_lm.discounts([sum(n == k for n in pair.values()) for k in (1, 2, 3, 4)])
    low = quality_lm.discounts([sum(n == k for n in before.values()) for k in (1, 2, 3, 4)])
    cut = {w: low[min(before[w], 3) - 1] if before[w] else 0.0 for w in every}
    all_pairs, rest = sum(before.values()), sum(cut.values()) / sum(before.values())
    p1 = {w: (before[w] - cut[w]) / all_pairs + rest / len(every) for w in every}
    assert abs(sum(p1.values()) - 1) < 1e-9

    def p2(a, b):
        if not total[a]:
            return p1[b]
        weight = sum(d[k - 1] * kinds[a][k] for k in (1, 2, 3)) / total[a]
        n = pair[a, b]
        return (max(n - d[min(n, 3) - 1], 0) if n else 0) / total[a] + weight * p1[b]

    for a in every[:20]:
        assert abs(sum(p2(a, b) for b in every) - 1) < 1e-9
    rows = Counter()
    for (a, _), n in spelled.items():
        rows[a] += n

    def nats(t):
        found = WORD.findall(t)
        ids = [0, *map(name, found)]
        out = -sum(math.log(p2(a, b)) for a, b in zip(ids[:-1], ids[1:], strict=True))
        for w in found:
            if w not in known:
                raw = b" " + w.encode() + b" "
                out -= sum(math.log((spelled[a, b] + 0.05) / (rows[a] + 256 * 0.05)) for a, b in zip(raw[:-1], raw[1:], strict=True))
        return out, len(found)

    mean = sum(nats(t)[0] for t in held) / sum(nats(t)[1] for t in held)
    return [math.exp((nats(t)[0] + prior * mean) / (nats(t)[1] + prior)) if nats(t)[1] else None for t in texts]


def test_perplexity_equals_a_plain_model(llm):
    rng = random.Random(8)
    rows = [(i, " ".join(samples.words(rng, rng.choice([5, 30, 80])))) for i in range(150)] + [(900, None), (901, " "), (902, "### *** !!! " * 300), (903, "LOUD WORDS!! " * 30), (None, "no id"), (3, "again")]
    docs = samples.documents(llm, rows).withColumn("lang", F.lit("xx"))
    labels = llm.createDataFrame([(i, int(i % 5 > 0)) for i in range(150)] + [(1, 1), (None, 1), (5000, 1)], "doc_id long, quality int")
    held = {r[0] for r in llm.range(0, 150).where(F.pmod(F.xxhash64("id"), F.lit(quality_lm.HELD_OUT)) == 0).collect()}
    trusted = [(i, t) for i, t in rows if i is not None and i < 150 and i % 5 > 0]
    got = quality_lm.judge(docs.repartition(3), labels).collect()
    assert len(got) == len(rows)
    want = brute_perplexity([t for i, t in trusted if i not in held], [t for i, t in trusted if i in held], [t or "" for _, t in rows], quality_lm.VOCABULARY, quality_lm.PRIOR_WORDS)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    mine = sorted(((r["doc_id"], r["n_words"], r["perplexity"]) for r in got), key=key)
    for (i, n, p), (j, m, q) in zip(mine, sorted(((i, len(WORD.findall(t or "")), w) for (i, t), w in zip(rows, want, strict=True)), key=key), strict=True):
        assert (i, n) == (j, m) and (p == q if p is None or q is None else math.isclose(p, q, rel_tol=1e-6))
    by_id = {r["doc_id"]: r for r in got}
    assert not by_id[902]["kept"] and not by_id[903]["kept"] and by_id[900]["kept"]
    assert sum(r["kept"] for r in got if r["doc_id"] is not None and r["doc_id"] < 150) >= 148


def test_models_share_their_tables(llm, monkeypatch):
    tables, plain = {}, quality_lm.written
    monkeypatch.setattr(quality_lm, "written", lambda df, name: tables.setdefault(name, plain(df, name)))
    rng = random.Random(11)
    # words that each model has; with others that only some models have twice
    common = {i: [f"w{rng.randrange(12)}" for _ in range(40)] for i in range(160)}
    for rare in (False, True):
        tables.clear()
        texts = {i: " ".join([*w, f"Rare{i // 4 % 37}x", f"{i // 6}-odd"] * 2 if rare and i % 3 else w) for i, w in common.items()}
        lang = {i: "xy"[i % 4 == 0] for i in texts}
        docs = llm.createDataFrame([(i, t, lang[i]) for i, t in texts.items()], "doc_id long, text string, lang string")
        assert quality_lm.judge(docs.repartition(3), docs.selectExpr("doc_id", "1 AS quality")).count() == len(texts)
        if not rare:
            starts_and_pairs = {(lang[i], a, b) for i, t in texts.items() for a, b in zip(["", *t.split()[:-1]], t.split(), strict=True)}
            assert tables["vocabulary"].count() == 24 and tables["pairs"].where("language >= 0").count() == len(starts_and_pairs)
            continue
        dealt = F.pmod(F.xxhash64("doc_id"), F.lit(quality_lm.HELD_OUT))
        fold = {r["doc_id"]: r["fold"] for r in docs.select("doc_id", F.when(dealt == 0, 0).otherwise(1 + F.floor((dealt - 1) / 3)).alias("fold")).collect()}
        got = defaultdict(list)
        for r in tables["held-out"].collect():
            got[r["lang"], r["fold"]].append(math.exp(r["nats"] / r["n"]))
        assert set(got) == {(x, k) for x in "xy" for k in range(quality_lm.FOLDS)}
        for (x, k), mine in got.items():
            train, held = ([texts[i] for i in texts if lang[i] == x and (fold[i] == k) == out] for out in (False, True))
            want = brute_perplexity(train, held, held, quality_lm.VOCABULARY, 0)
            assert all(math.isclose(p, q, rel_tol=1e-6) for p, q in zip(sorted(mine), sorted(want), strict=True))


def test_quality_without_labels_or_documents(llm):
    docs = samples.documents(llm, samples.texts()[:10])
    none = llm.createDataFrame([], "doc_id long, quality int")
    assert all(r["kept"] and r["perplexity"] is None for r in quality_lm.judge(docs, none).collect())
    assert quality_lm.judge(samples.documents(llm, []), none).count() == 0
    assert quality_lm.keep_good(docs, none).columns == docs.columns


def test_neither_words_nor_languages_are_limited(llm):
    rng = random.Random(9)
    many = [f"v{k}" for k in range(70_000)] * 3
    rng.shuffle(many)
    texts = [" ".join(many[k:k + 2000]) for k in range(0, len(many), 2000)]
    rows = [(i, t, "xx") for i, t in enumerate(texts)] + [(10_000 + 100 * x + k, f"only{x} " * (40 if x < 69 else 3) + f"and{x}", f"l{x}") for x in range(70) for k in range(12 if x < 69 else 8)]
    docs = llm.createDataFrame([(i, t, lang, "s") for i, t, lang in rows], "doc_id long, text string, lang string, source string")
    labels = docs.selectExpr("doc_id", "1 AS quality")
    held = {r[0] for r in docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(quality_lm.HELD_OUT)) == 0).select("doc_id").collect()}
    got = {r["doc_id"]: r["perplexity"] for r in quality_lm.judge(docs.repartition(3), labels).collect()}
    assert len(got) == len(rows) and all(p is not None for p in got.values())
    train = [t for i, t in enumerate(texts) if i not in held]
    assert sum(n > 1 for n in Counter(w for t in train for w in t.split()).values()) > 65_536
    counts = brute_perplexity(train, [t for i, t in enumerate(texts) if i in held], texts[:3], quality_lm.VOCABULARY, quality_lm.PRIOR_WORDS)
    assert all(math.isclose(got[i], p, rel_tol=1e-6) for i, p in enumerate(counts))


def test_thresholds_of_given_documents(llm):
    sf = "/root/testdata/sf0.01"
    labels = llm.read.parquet(f"{sf}/labels.parquet")
    found = quality_lm.judge(llm.read.parquet(f"{sf}/documents.parquet"), labels).collect()
    quality = {r["doc_id"]: r["quality"] for r in labels.collect()}
    gone = Counter((r["lang"], quality.get(r["doc_id"])) for r in found if not r["kept"])
    assert gone["en", 0] >= 36 and gone["es", 0] == 5
    assert sum(n for (_, q), n in gone.items() if q == 1) <= 0.02 * sum(quality.get(r["doc_id"]) == 1 for r in found)


def test_a_small_language_rejects_junk(llm):
    rng = random.Random(10)
    rows = [(i, " ".join(samples.words(rng, 60)), "xx") for i in range(150)] + [(200 + k, " ".join(samples.words(rng, 60, 0.1)), "yy") for k in range(4)] + [(300, "&&&&Q!! ****Q!! " * 100, "yy")]
    docs = llm.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = llm.createDataFrame([(i, int(i < 300)) for i, _, _ in rows], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality_lm.judge(docs, labels).collect()}
    assert got[200]["threshold"] is not None and not got[300]["kept"]
    assert sum(got[i]["kept"] for i in (200, 201, 202, 203)) >= 3


def test_shapes():
    texts = ["a The ABC aBc x1 ... don't end. &&& w*** ÉÉ É é! A"]
    assert quality_lm.shapes(hashing.Words([t.encode() for t in texts])).tolist() == [shape(w) for w in texts[0].split()]


PAGE = ('<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href="/">Home</a></li><li><a>News</a></li></ul></nav><script>var t="</p>";</script>'
        '<!-- ad --><div class="ad">Buy now</div><article><h1>Head %d</h1><p><b>First  line &amp; more<br>\n here %s<p>Second line.</p><ul><li>x<li>y</ul></article><footer>&copy; me</footer>')


def test_blocks_of_broken_markup():
    found = html_blocks.blocks(PAGE % (1, 2))
    assert [b.text for b in found] == ["T", "Home", "News", "Buy now", "Head 1", "First line & more here 2", "Second line.", "x", "y", "© me"]
    assert [("article" in b.path) for b in found] == [False] * 4 + [True] * 5 + [False]
    assert found[1].linked == 4
    assert [b.text for b in html_blocks.blocks("a < b <p>c<script>never ended")] == ["a < b", "c"]
    assert html_blocks.blocks("") == [] and html_blocks.blocks("<p></p><!-- x") == []
    assert [b.text for b in html_blocks.blocks("text <b")] == ["text"]


@pytest.mark.parametrize("page, n", [
    ("<a " * 350_000, 0), ('<a b="x' * 150_000, None), ("<a b='\"x" * 120_000, None), ('<a "' * 250_000, None), ("<" * 1_000_000, 1), ("<!-" * 300_000, 0), ("<p title=it's>x</p>" * 20_000, 20_000),
    ("<div>x" * 20_000, 20_000), ("<ul><li>x" * 20_000, 20_000), ("<b>" * 20_000 + "x</i></b>" * 20_000, 1), ("".join(f'<div class="c{i}">x' for i in range(20_000)), 20_000)])
def test_time_grows_with_a_broken_page(page, n):
    took = time.process_time()
    found = html_blocks.blocks(page)
    # ten times what is expected; at quadratic time these take minutes
    assert time.process_time() - took < 10 and (n is None or len(found) == n)
    if n == 20_000:
        took = time.process_time()
        assert block_labeller.features(found).shape == (n, block_labeller.DIM) and time.process_time() - took < 20


def test_quotes_and_open_tags():
    assert [b.text for b in html_blocks.blocks("<p title=it's>one</p><p>don't</p>")] == ["one", "don't"]
    assert [b.text for b in html_blocks.blocks('<p title="a > b <i>">one</p><div <p>two')] == ["one", "two"]
    found = html_blocks.blocks('<div class="x y"><div class=x><p>one<p>two</div>three')
    assert [tuple(b.path) for b in found] == [("div", "x", "y", "div", "x", "p")] * 2 + [("div", "x", "y")]
    assert found[0].path is found[1].path and "y" in found[1].path and found[0].path.fresh == ("p",)


def test_extraction(llm):
    rng = random.Random(3)
    said = {i: " ".join(samples.words(rng, rng.choice([4, 15, 50]), 0.8)) for i in range(150)}
    rows = [(i, f"http://x/{i}", PAGE % (i, said[i])) for i in said]
    rows += [(1000, None, None), (1001, "u", ""), (None, "u", PAGE % (7, said[7])), (0, "http://x/0", PAGE % (0, said[0]))]
    pages = llm.createDataFrame([(*r, "?", "?") for r in rows], "page_id long, url string, html string, id string, text string")
    got = sorted((tuple(r) for r in block_labeller.extract(pages).select("page_id", "url", "text").collect()), key=repr)
    text = lambda i: f"Head {i}\nFirst line & more here {said[i]}\nSecond line.\nx\ny"
    want = [(i, f"http://x/{i}", text(i)) for i in [*said, 0]] + [(1000, None, ""), (1001, "u", ""), (None, "u", text(7))]
    assert got == sorted(want, key=repr)
    assert block_labeller.extract(pages.limit(0)).count() == 0


def test_extraction_of_given_pages_and_another_layout(llm):
    own = ('<html><body><div class="cookie-banner">We use cookies here</div><div id="header"><a href="/">Home</a></div><div class="sidebar"><ul><li><a>one</a></li></ul></div><div class="post-content"><h1>Title of it</h1>'
           '<p>A first paragraph of the text.</p><p>And a second one.</p></div><div class="comments"><p>Nice post, thanks a lot.</p></div><form><label>Name</label></form><footer>(c) me</footer></body></html>')
    given = llm.read.parquet("/root/testdata/sf0.01/pages.parquet")
    pages = given.unionByName(llm.createDataFrame([(-1, "u", own)], given.schema))
    got = {r["page_id"]: r["text"] for r in block_labeller.extract(pages).collect()}
    assert got.pop(-1) == "Title of it\nA first paragraph of the text.\nAnd a second one."
    want = {r["page_id"]: "\n".join(b.text for b in html_blocks.blocks(r["html"]) if "article" in b.path) for r in given.collect()}
    assert sum(got[i] == want[i] for i in want) >= 0.99 * len(want)


def test_gradients_of_the_labeller():
    rng = np.random.Generator(np.random.PCG64(1))
    model = block_labeller.Labeller(3)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, mask = block_labeller.padded([rng.standard_normal((n, block_labeller.DIM)) for n in (1, 4, 6)])
    y = (rng.random(mask.shape) < 0.5).astype(float)

    def loss():
        z = model.logits(x, mask)[0].astype(float)
        return float(((np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0) - z * y) * mask).sum() / mask.sum())

    grads = model.gradients(x, mask, y)
    for name in model.p:
        at = tuple(int(rng.integers(n)) for n in model.p[name].shape)
        held, step = model.p[name][at], 1e-3
        model.p[name][at] = held + step
        up = loss()
        model.p[name][at] = held - step
        down = loss()
        model.p[name][at] = held
        assert abs((up - down) / (2 * step) - grads[name][at]) < 2e-3, name


def test_a_slice_and_a_pair_are_sent_once(llm, monkeypatch):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(30))) for i in range(60)]
    kept, asked, write = {}, [], quality_lm.written
    monkeypatch.setattr(quality_lm, "written", lambda df, name: kept.setdefault(name, write(df, name)))
    own = quality_lm._of_slice
    monkeypatch.setattr(quality_lm, "_of_slice", lambda df: asked.append(df) or own(df))
    docs = samples.documents(llm, rows)
    got = quality_lm.judge(docs, llm.createDataFrame([(i, 1) for i in range(60)], "doc_id long, quality int")).collect()
    assert len(got) == 60 and all(r["n_words"] == 30 for r in got)
    # the answers of all models come together at their slice
    slices = {r["slice"]: r["fold"] for r in kept["slices"].collect()}
    for df, models in zip(asked, (lambda f: {0, 1, 2, 3} - {f}, lambda f: {0, f}), strict=True):
        by_slice = defaultdict(set)
        for r in df.select("slice", F.expr(f"slice div {quality_lm.FOLDS}").alias("of")).distinct().collect():
            by_slice[r["of"]].add(r["slice"] % quality_lm.FOLDS)
        assert by_slice == {s: models(f) for s, f in slices.items()}
    # a pair is known by its words, without a hash of its own
    assert kept["pairs"].columns == ["language", "first", "second", "n"]


def brute_nearest(rows, k, every):
    good = [(i, np.array(v)) for i, v in rows if v is not None and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in good:
        if i is not None and i % every == 0:
            out[i] = sorted(((-float(v @ q), j if j is not None else 1 << 62) for j, v in good if j != i))[:k]
    return out


def test_nearest_vectors(llm):
    rng = np.random.Generator(np.random.PCG64(2))
    rows = [(i, (rng.standard_normal(8) * rng.uniform(0.5, 3)).tolist()) for i in range(900)]
    rows += [(1000 + i, rows[5][1]) for i in range(30)] + [(2000, None), (2001, [0.0] * 8), (2002, [1.0] * 7 + [None]), (2003, [1.0] * 7 + [math.inf]), (2004, [math.nan] * 8), (2005, [1.0] * 3), (None, rows[3][1]), rows[9], rows[9]]
    table = llm.createDataFrame([(i, v, "?", "?") for i, v in rows], "vec_id long, embedding array<float>, id string, v string")
    plain = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    rows = list({(i, tuple(v) if v else None): (i, v) for i, v in plain}.values())
    got = defaultdict(list)
    for r in collision_search.nearest(table, 20, F.col("vec_id") % 20 == 0, index_block=300, query_block=20).orderBy("query_id", "rank").collect():
        assert r["rank"] == len(got[r["query_id"]]) + 1
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    want = brute_nearest(rows, 20, 20)
    assert set(got) == set(want)
    hits = total = 0
    for q, best in want.items():
        assert len(got[q]) == 20 and all(a[1] > b[1] or a[1] == b[1] and (b[0] is None or a[0] < b[0]) for a, b in zip(got[q][:-1], got[q][1:], strict=True))
        hits += len({j if j is not None else 1 << 62 for j, _ in got[q]} & {j for _, j in best})
        total += 20
    assert hits / total >= 0.95


def test_search_begins_with_any_windows(monkeypatch):
    rng = np.random.Generator(np.random.PCG64(4))
    vectors = rng.standard_normal((700, 16))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    queries, directions = vectors[:40], collision_search.projections(16, 64, 7)
    index, halves = collision_search.CollisionIndex(vectors, directions), collision_search.half_widths(1.0, 8.0)
    lows, highs = index.windows(queries, halves)
    distance = lambda s: np.sqrt(np.maximum(2 - 2 * s, 0.0))
    counted, count = [], collision_search.CollisionIndex.collisions
    monkeypatch.setattr(collision_search.CollisionIndex, "collisions", lambda self, *windows: counted.append(1) or count(self, *windows))
    start, steps = 0, []
    for q, low, high in zip(queries, lows, highs, strict=True):
        apart = np.abs((vectors - q) @ directions.T)
        assert [count(index, low[i], high[i]).tolist() for i in (0, 5)] == [(apart <= halves[i]).sum(axis=1).tolist() for i in (0, 5)]
        search = lambda at, q=q, low=low, high=high: index.search(low, high, halves, 21, lambda r: vectors[r] @ q, distance, 0.5, 0.85, at)
        rows, scores, ended = search(0)
        for at in (ended // 2, ended, len(halves) - 1):
            other = search(at)
            assert other[0].tolist() == rows.tolist() and np.allclose(other[1], scores, atol=1e-12) and other[2] == ended
        assert np.sort(distance(scores))[20] <= halves[ended] / 0.85 and ended + 1 < len(halves)
        counted.clear()
        start = search(max(start - 1, 0))[2]
        steps.append((len(counted), ended + 1))
    # far fewer windows are counted than from the first ones on
    assert sum(a for a, _ in steps) < 0.6 * sum(b for _, b in steps)


def test_equal_vectors_are_equally_near(llm):
    v = np.random.Generator(np.random.PCG64(1)).standard_normal((2, 64)).tolist()
    found = collision_search.nearest(llm.createDataFrame([(0, v[0]), *((i, v[1]) for i in range(1, 1004))], "vec_id long, embedding array<double>").coalesce(1), 1003, F.col("vec_id") == 0).collect()
    assert len({r["score"] for r in found}) == 1 and [r["vec_id"] for r in sorted(found, key=lambda r: r["rank"])] == list(range(1, 1004))


def test_fewer_candidates_than_asked_for(llm):
    rows = [(i, [float(i), 1.0]) for i in range(0, 100, 20)]
    found = collision_search.nearest(llm.createDataFrame(rows, "vec_id long, embedding array<float>"), 20, F.col("vec_id") % 20 == 0).collect()
    assert len(found) == 5 * 4 and {r["rank"] for r in found} == {1, 2, 3, 4}
    assert collision_search.nearest(llm.createDataFrame([], "vec_id long, embedding array<float>"), 20, F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("url, host, path, rule, verdict", [
    ("https://WWW.Example.org/es/1?x", "www.example.org", "/es/1", "example.org/es/", "block"),
    ("http://example.org/en/12#a", "example.org", "/en/12", "example.org/en/1", "block"),
    ("http://notexample.org/es/1", "notexample.org", "/es/1", "org/", "allow"),
    ("http://a.com/fr/x", "a.com", "/fr/x", "com/fr/", "allow"),
    ("http://a.com/de/", "a.com", "/de/", "com/de/", "block"),
    ("http://x.org", "x.org", "", None, None),
    ("http://org/a", "org", "/a", "org/", "allow"),
    ("x.org/es/", "", "", None, None), (None, "", "", None, None), ("", "", "", None, None),
    ("a://b://c", "b:", "//c", None, None),
])
def test_url_rules(llm, url, host, path, rule, verdict):
    df = llm.createDataFrame([(1, url)], "page_id long, url string")
    h, p = url_templates.host_and_path(F.col("url"))
    r = df.select(h.alias("host"), p.alias("path")).withColumns({"rule": url_templates._by_rule(url_templates.RULES, lambda x: x.text), "said": url_templates._by_rule(url_templates.RULES, lambda x: x.verdict)}).first()
    assert tuple(r) == (host, path, rule, verdict)


def test_url_templates(llm):
    urls = [f"http://a{k % 4}.com/de/{k}" for k in range(40)] + [f"http://a{k % 4}.com/fr/{k}" for k in range(40)] + [f"http://b.org/en/{k}.html" for k in range(40)]
    urls += [f"http://c.net/{x}/{k}" for x in ("de", "fr", "en") for k in range(5)] + [f"http://d.net/user/name{chr(97 + k)}{chr(98 + k)}x" for k in range(24)]
    urls += [None, "", "no scheme", "http://", "http://deep.net/" + "/".join("abcdefghijklmnop"), urls[0], urls[0]]
    pages = llm.createDataFrame([(i, u, "?", "?", "?") for i, u in enumerate(urls)] + [(None, "http://c.net/de/9", "?", "?", "?")], "page_id long, url string, host string, id string, n string")
    got = url_templates.filter_urls(pages).collect()
    assert len(got) == len(urls) + 1 and not any(r["verdict"] is None for r in got)
    by = {r["page_id"]: r for r in got}
    at = {u: i for i, u in enumerate(urls)}
    assert by[at["http://c.net/de/3"]]["verdict"] == "block" and by[None]["verdict"] == "block"
    assert by[at["http://c.net/fr/3"]]["verdict"] == by[at["http://c.net/en/3"]]["verdict"] == "allow"
    assert by[at["http://c.net/de/3"]]["template"] == "/de/<n>" and by[at["http://b.org/en/7.html"]]["template"] == "/en/<n>.html"
    assert by[at["http://d.net/user/nameabx"]]["template"] == "/user/<any>"
    assert by[at["http://deep.net/" + "/".join("abcdefghijklmnop")]]["template"] == "/" + "/".join("abcdefghijklmnop")
    assert by[at[""]]["host"] == "" and by[at[None]]["template"] == "/"
    plan = url_templates.filter_urls(pages)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)
    assert url_templates.filter_urls(pages.limit(0)).count() == 0


def test_url_templates_of_deep_paths(llm):
    top = "/".join("abcdefghijk")
    urls = [f"http://x.com/{top}/{last}/{k}" for last in ("good", "bad") for k in range(30)] + ["http://y.net/" + "s/" * 1500 + "end"]
    rules = (url_templates.Rule("allow", "x.com", f"/{top}/good/1"), url_templates.Rule("block", "x.com", f"/{top}/bad/1"))
    got = {r["page_id"]: r for r in url_templates.filter_urls(llm.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()}
    # paths of 13 segments that differ in the twelfth only
    assert [got[k]["verdict"] for k in (5, 35)] == ["allow", "block"] and got[35]["rule"] is None
    assert got[35]["template"] == f"/{top}/bad/<n>" and got[60]["template"].endswith("s/s/end") and got[60]["template"].count("/") == 1501
