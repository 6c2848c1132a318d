"""Terms of a table against every text by ``in``; scores and categories against the literal rules."""

import random

import pytest

from feedweave import schemas
from feedweave.operators import curate, term_match

TEXTS = ["", None, "a", "ab", "abc", "The Theme", "über alles", "ÜBER", "日本語の", "a b c", "x" * 3000 + "abd", "the the the", "𝔘𝔫𝔦code", "tab\there"]


def test_matches(spark):
    rnd = random.Random(1)
    words = ["the", "theme", "abc", "abd", "über", "日本", "zz", "a", "b", "code"]
    texts = TEXTS + [" ".join(rnd.choice(words) for _ in range(rnd.randrange(9))) for _ in range(60)]
    terms = ["the", "The", "a", "ab", "abc", "zzzz", "", None, "ÜB", "本語", "e th", "abd", "theme the", "𝔘𝔫", "\t", "the"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").repartition(4)
    table = spark.createDataFrame([(t, "?") for t in terms], "term string, gram string")
    got = sorted((r.k, r.term) for r in term_match.matches(rows, "t", ["k"], table).collect())
    want = sorted({(k, t.lower()) for k, x in enumerate(texts) for t in terms if x is not None and t is not None and t.lower() in x.lower()})
    assert got == want
    assert term_match.matches(rows, "t", ["k"], table.limit(0)).count() == 0
    assert term_match.matches(rows.limit(0), "t", ["k"], table).count() == 0


def test_many_rules_as_the_literal_ones(spark):
    rnd = random.Random(2)
    kinds = ["prefer", "seek", "less", "skip", "category"]
    rules = [{"kind": rnd.choice(kinds), "term": "".join(rnd.choice("abcdE ") for _ in range(rnd.randrange(1, 5))), "label": f"l{i}", "weight": rnd.randrange(-2, 3), "priority": i}
             for i in range(300)]
    rules += rules[:20]  # repeated rules count again
    items = spark.createDataFrame([(t, i, "o", "".join(rnd.choice("abcdeE ") for _ in range(12)), rnd.choice([None, "ed dab"])) for t in ("org", "press") for i in range(40)],
                                  "digest_type string, item_no long, org string, title string, summary string").repartition(3)
    table = spark.createDataFrame([tuple(r.get(f.name) for f in schemas.RULE.fields) for r in rules], schemas.RULE)
    key = lambda r: (r.digest_type, r.item_no)
    want = curate.categorise(curate.score_items(items, rules), rules)
    got = curate.categorise_by_table(curate.score_by_table(items, table), table)
    assert sorted(got.collect(), key=key) == sorted(want.select(*got.columns).collect(), key=key)


def test_themes_beyond_the_summary(spark):
    cols = "digest_type string, source_idx int, pos int, title string, summary string, description string"
    entries = spark.createDataFrame([("org", 0, 0, "A", "x " * 700 + "<b>beyond</b>", None), ("org", 1, 0, "B", "", "y " * 900 + "Beyond")], cols)
    articles = spark.createDataFrame([("org", 0, 0, 1, "o1"), ("org", 1, 0, 2, "o2")], "digest_type string, source_idx int, pos int, item_no long, org string")
    found = curate.theme_candidates(curate.with_whole_text(articles, entries)).collect()
    assert [(r.term, r.n_items, r.n_orgs) for r in found] == [("beyond", 2, 2)]


def test_nothing_but_counts_is_shuffled_however_many_terms(spark, monkeypatch):
    monkeypatch.setattr(term_match, "SLICE_TERMS", 7)
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abü") for _ in range(rnd.randrange(9))) for _ in range(60)]
    texts = [" ".join(rnd.choice(words) for _ in range(6)) for _ in range(30)]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").repartition(3)
    table = spark.createDataFrame([(w, i) for i, w in enumerate(dict.fromkeys(words))], "term string, place int")
    found = term_match.matches(rows, "t", ["k"], table, carried=("place",))
    assert sorted(map(tuple, found.collect())) == sorted((k, w, i) for k, x in enumerate(texts) for i, w in enumerate(dict.fromkeys(words)) if w in x)
    # runs and hits meet by broadcast: one exchange of the texts a slice, and no join by shuffle
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("BroadcastHashJoin") == -(-len(set(words)) // 7) and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


def test_a_word_of_many_items_meets_the_rules_once(spark):
    words = ["alphabet", "alphabetic", "betting"]
    rules = [{"kind": ("prefer", "less")[i % 2], "term": t, "label": "", "weight": i % 3 - 1, "priority": 0} for i, t in enumerate(sorted({w[i:j] for w in words for i in range(len(w)) for j in range(i + 1, len(w) + 1)}))]
    items = spark.createDataFrame([("org", i, "", f"{i} " + ", ".join(words)) for i in range(100)], "digest_type string, item_no long, title string, summary string").repartition(3)
    table = spark.createDataFrame([tuple(r.get(f.name) for f in schemas.RULE.fields) for r in rules], schemas.RULE)
    scored = curate.score_by_table(items, table)
    assert {(r.score, r.dropped) for r in scored.collect()} == {(sum(r["weight"] for r in rules), False)}

    def met(node):  # rows that joins make
        kind, below = node.getClass().getSimpleName(), node.children()
        inner = [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else [below.apply(i) for i in range(below.size())]
        own = node.metrics().get("numOutputRows").get().value() if "Join" in kind else 0
        return own + sum(map(met, inner))
    # each of the 100 items has more than 70 terms, but only 4 words
    assert len(rules) > 70 and met(scored._jdf.queryExecution().executedPlan()) < 100 * 10


@pytest.mark.parametrize("slice_terms", [1 << 20, 3])
def test_terms_in_words_and_beside_them(spark, monkeypatch, slice_terms):
    monkeypatch.setattr(term_match, "SLICE_TERMS", slice_terms)
    texts = ["naïve CAFÉ-bar 日本語" + "漢字" * 40 + "末尾", "école 42nd st", "x" * 200 + "tail" + "y" * 31 + "z", "", None, "ab\nab", "ΑΣ ΑΣΑ"]
    terms = ["é", "fé-b", "語漢字", "字末尾", "漢字" * 17, "é", "2n", "tail" + "y" * 28, "tail" + "y" * 29, "yz", "", " ", "b\na", "ab\n", "ς", "ασα", "x" * 32, "x" * 200 + "t"]
    rows = [("org", i % 2 if i < 4 else i, t, None) for i, t in enumerate([*texts, texts[0]])]  # two keys are there twice
    items = spark.createDataFrame(rows, "digest_type string, item_no long, title string, summary string").repartition(3)
    rules = [{"kind": ("prefer", "less", "category")[i % 3], "term": t, "label": f"l{i}", "weight": 1 << i, "priority": -i // 4} for i, t in enumerate(terms)]
    table = spark.createDataFrame([tuple(r.get(f.name) for f in schemas.RULE.fields) for r in rules], schemas.RULE)
    got = {(r.item_no, r.title): (r.score, r.category) for r in curate.categorise_by_table(curate.score_by_table(items, table), table).collect()}
    for _, key, title, _ in rows:
        hits = [r for _, k, t, _ in rows if k == key for r in rules if r["term"] in ((t or "").lower() + " ")]
        first = min(((r["priority"], r["label"]) for r in hits if r["kind"] == "category"), default=(0, "General"))
        assert got[key, title] == (sum(r["weight"] for r in hits if r["kind"] != "category"), first[1])
