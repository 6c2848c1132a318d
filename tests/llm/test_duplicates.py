"""Exact dedup, n-gram join and substring dedup against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import time

import numpy as np
import pytest

from feedweave.llm import exact_dedup, graph, ngram_join, substring_dedup

from . import samples

SPACE = re.compile(r"[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def first(ids):
    known = [i for i in ids if i is not None]
    return min(known) if known else None


@pytest.mark.parametrize("digest_bytes, files", [(32, None), (32, 1), (1, None)])
def test_exact_dedup(llm, digest_bytes, files):
    rows = samples.texts()
    groups = {}
    for i, t in rows:
        groups.setdefault(SPACE.sub(" ", t or ""), []).append(i)
    got = exact_dedup.dedup_exact(samples.documents(llm, rows).repartition(3), digest_bytes=digest_bytes, files_per_trigger=files)
    want = [(i, first(g), len(g), hashlib.sha256(n.encode()).hexdigest()) for n, g in groups.items() for i in g]
    assert samples.rows_of(got, "doc_id", "keep_id", "group_size", "text_sha256") == sorted(want, key=repr)
    kept = [r for r in got.collect() if r["kept"]]
    assert sorted(r["text_sha256"] for r in kept) == sorted(hashlib.sha256(n.encode()).hexdigest() for n in groups)
    assert all(r["doc_id"] == r["keep_id"] for r in kept)


def test_stream_goes_on_from_its_state(llm, scratch_dir):
    base, staged = f"{scratch_dir}/state", f"{scratch_dir}/staged"
    place = "named_struct('no_id', false, 'id', id, 'row', id, 'file', '') AS place"
    part = lambda a, b: llm.range(a, b).selectExpr("cast(cast(id % 3 AS string) AS binary) AS digest", place)
    part(10, 16).coalesce(1).write.parquet(staged)
    schema = llm.read.parquet(staged).schema
    exact_dedup.stream_state(llm, staged, schema, checkpoint=base)
    part(0, 5).coalesce(1).write.mode("append").parquet(staged)
    state = exact_dedup.stream_state(llm, staged, schema, checkpoint=base)
    assert sorted((bytes(r["digest"]), r["keeper"]["id"], r["n"]) for r in state.collect()) == [(b"0", 0, 4), (b"1", 1, 4), (b"2", 2, 3)]


def test_exact_dedup_of_nothing(llm):
    assert exact_dedup.dedup_exact(samples.documents(llm, [])).count() == 0


def test_keep_first_keeps_whole_rows(llm):
    docs = samples.documents(llm, samples.texts())
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({SPACE.sub(" ", t or "") for _, t in samples.texts()})


def shingles(text, n):
    found = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(found[k:k + n]) for k in range(len(found) - n + 1)} if len(found) >= n else ({tuple(found)} if found else set())


def brute_components(rows, n, percent):
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    return sorted(((rows[i][0], len(sets[i]), first(groups[find(i)]) if sets[i] else rows[i][0]) for i in range(len(rows))), key=repr)


@pytest.mark.parametrize("n, percent, block", [(4, 85, None), (5, 80, 100), (2, 50, 300)])
def test_ngram_join(llm, monkeypatch, n, percent, block):
    if block:  # groups larger than a block are searched in pairs of blocks
        monkeypatch.setattr(ngram_join, "BLOCK_POSTINGS", block)
        monkeypatch.setattr(ngram_join, "FREQUENT_SHARE", 0.05)
    rows = samples.texts(n)
    got = ngram_join.join_components(samples.documents(llm, rows).repartition(3), n, percent)
    assert samples.rows_of(got, "doc_id", "n_shingles", "component_id") == brute_components(rows, n, percent)


@pytest.mark.parametrize("n, percent, block", [(4, 85, None), (5, 80, 100)])
def test_every_link_is_counted(llm, monkeypatch, n, percent, block):
    if block:
        monkeypatch.setattr(ngram_join, "BLOCK_POSTINGS", block)
        monkeypatch.setattr(ngram_join, "FREQUENT_SHARE", 0.05)
    rows = samples.texts(n)
    sets = [shingles(t, n) for _, t in rows]
    links = [sum(i != j and bool(a and b) and 100 * len(a & b) >= percent * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)]
    got = ngram_join.join_links(samples.documents(llm, rows).repartition(3), n, percent)
    assert samples.rows_of(got, "doc_id", "n_shingles", "component_id") == brute_components(rows, n, percent)
    assert samples.rows_of(got, "doc_id", "n_shingles", "n_links") == sorted(((i, len(s), k) for (i, _), s, k in zip(rows, sets, links, strict=True)), key=repr)
    assert max(links) > 8


def test_ngram_join_of_nothing(llm):
    assert ngram_join.join_components(samples.documents(llm, [])).count() == 0
    only_empty = samples.documents(llm, [(1, None), (2, ""), (3, "a")])
    assert samples.rows_of(ngram_join.join_components(only_empty), "doc_id", "n_shingles", "component_id") == [(1, 0, 1), (2, 0, 2), (3, 1, 3)]


def test_divide_skip_search_and_group():
    rng = random.Random(6)
    for percent in (50, 80, 85):
        for _ in range(60):
            pool = range(rng.choice([6, 12, 40]))
            sets = [set(rng.sample(pool, rng.randrange(1, len(pool)))) for _ in range(14)]
            sets += [s ^ {rng.choice(list(pool))} or {0} for s in sets]
            index = ngram_join.DivideSkip(percent, rng.choice([0.01, 0.1, 1.0]))
            for s in sets:
                index.add(sorted(s), len(s))
            link = lambda a, b: 100 * len(a & b) >= percent * len(a | b)
            for s in sets:
                assert sorted(index.search(sorted(s), len(s))) == [j for j, o in enumerate(sets) if link(s, o)]
            edges = ngram_join.search_group([(len(s), sorted(s)) for s in sets], percent)
            assert all(link(sets[i], sets[j]) for i, j in edges) and len(edges) < len(sets)
            label = {i: i for i in range(len(sets))}
            for _ in sets:
                for i, j in edges:
                    label[i] = label[j] = min(label[i], label[j])
            assert all(label[i] == label[j] for i in range(len(sets)) for j in range(i) if link(sets[i], sets[j]))


def test_links_of_packed_lists(monkeypatch):
    rng = random.Random(9)
    for _ in range(200):
        percent, pool, kinds = rng.choice([50, 80, 85]), range(rng.choice([6, 12, 40])), rng.choice([1, 2])
        monkeypatch.setattr(ngram_join, "PROBE", rng.choice([0.01, 8, 1000]))
        monkeypatch.setattr(ngram_join, "COUNTED", rng.choice([1, 20, 1000]))
        sets = [set(rng.sample(pool, rng.randrange(1, len(pool)))) for _ in range(14)]
        sets += [s ^ {rng.choice(list(pool))} or {0} for s in sets]
        copies, blocks = [rng.randrange(1, 4) for _ in sets], [rng.randrange(kinds) for _ in sets]
        pairs = [(i, j) for j in range(len(sets)) for i in range(j) if (len(set(blocks)) == 1 or blocks[i] != blocks[j]) and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
        want = [sum(copies[a + b - i] for a, b in pairs if i in (a, b)) for i in range(len(sets))]
        count, edges = ngram_join.search_links([(len(s), np.array(sorted(s), dtype=np.uint64)) for s in sets], copies, blocks, percent)
        assert count == want
        assert all(tuple(sorted(e)) in pairs for e in edges)
        label = list(range(len(sets)))
        for i, j in edges:
            assert label[i] != label[j]
            label = [label[i] if x == label[j] else x for x in label]
        assert all(label[i] == label[j] for i, j in pairs)


def test_links_of_many_near_copies_are_found_in_numpy_passes():
    rng = np.random.Generator(np.random.PCG64(3))
    base, n = rng.integers(0, 1 << 62, 200, dtype=np.uint64), 600
    sets = [(200, np.sort(np.where(rng.random(200) > 0.03, base, rng.integers(0, 1 << 62, 200, dtype=np.uint64)))) for _ in range(n)]
    start = time.process_time()
    count, edges = ngram_join.search_links(sets, [1] * n, [0] * n, 85)
    # 10 us a pair; a merge and probes entry by entry took 20 or more
    assert time.process_time() - start < n * n / 2 * 1e-5
    assert n - 10 < len(edges) < n and sum(count) > 0.9 * n * (n - 1)


def test_components(llm):
    edges = [(1, 2), (2, 3), (3, 1), (7, 6), (6, 7), (5, 5), (9, 8), (8, 2), *((i, i + 1) for i in range(20, 60)), *((100, i) for i in range(101, 160))]
    got = {r["node"]: r["component"] for r in graph.connected_components(llm.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in (1, 2, 3, 8, 9)}, 6: 6, 7: 6, **{i: 20 for i in range(20, 61)}, **{i: 100 for i in range(100, 160)}}
    assert graph.connected_components(llm.createDataFrame([], "a long, b long")).count() == 0


def brute_removal(rows, n):
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    seen = {}
    for _, w in split:
        for k in range(len(w) - n + 1):
            seen[tuple(w[k:k + n])] = seen.get(tuple(w[k:k + n]), 0) + 1
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if seen[tuple(w[k:k + n])] > 1:
                gone[k:k + n] = [True] * n
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("n, gram, shard", [(35, 8, None), (6, 3, 40), (2, 8, None)])
def test_substring_dedup(llm, monkeypatch, n, gram, shard):
    if shard:  # groups larger than a shard
        monkeypatch.setattr(substring_dedup, "SHARD_WORDS", shard)
    rows = samples.texts(n)
    got = substring_dedup.remove_repeats(samples.documents(llm, rows).repartition(3), n, anchor_words=gram)
    assert samples.rows_of(got, "doc_id", "n_words", "n_removed", "text") == brute_removal(rows, n)


def test_substring_dedup_carries_columns_and_leaves_untouched_texts(llm):
    docs = samples.documents(llm, [(1, "a  b\tc"), (2, None)])
    got = substring_dedup.remove_repeats(docs, 5, carry=("lang", "kept"), as_is=True)
    assert samples.rows_of(got, "doc_id", "text", "lang", "kept") == [(1, "a  b\tc", "en", "?"), (2, "", "de", "?")]
    assert substring_dedup.remove_repeats(samples.documents(llm, []), 5).count() == 0


def test_automaton_counts_places():
    rng = random.Random(3)
    for _ in range(300):
        n = rng.choice([2, 3, 4])
        sequences = [[rng.randrange(3) for _ in range(rng.randrange(1, 14))] for _ in range(rng.randrange(1, 5))]
        weights = [rng.choice([1, 1, 2]) for _ in sequences]
        automaton, seen = substring_dedup.SuffixAutomaton(), {}
        for s, w in zip(sequences, weights, strict=True):
            automaton.add(s, w)
            for i in range(len(s) - n + 1):
                seen[tuple(s[i:i + n])] = seen.get(tuple(s[i:i + n]), 0) + w
        automaton.close()
        for s in [*sequences, [rng.randrange(3) for _ in range(10)]]:
            for places in (1, 2):
                want, got = [False] * len(s), [False] * len(s)
                for i in range(len(s) - n + 1):
                    if seen.get(tuple(s[i:i + n]), 0) >= places:
                        want[i:i + n] = [True] * n
                for a, b in automaton.covered(s, n, places):
                    got[a:b] = [True] * (b - a)
                assert got == want
