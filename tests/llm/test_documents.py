"""Operators on documents against brute force, and their cases: nulls, empty and long texts, ties, copies, empty tables,
extra columns."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import decontaminate, jaccard, langid, packing, pii, quality, suffix

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, key string, w int"
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, texts, lang="en", first=0):
    """Documents with columns whose names clash with those the operators use inside."""
    rows = [(i if i is None else i + first, t, lang, "s", len(t or ""), 7, "k", 1) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


def prose(rnd, n):
    return " ".join("".join(rnd.choice("abdeilnorst") for _ in range(rnd.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(5)
    texts = [prose(rnd, rnd.choice([0, 1, 2, 3, 5, 8, 12, 20, 60, 120, 400])) for _ in range(60)]
    passage = prose(rnd, 60)
    for t in list(texts[:20]):
        w = t.split()
        for _ in range(3):
            c = list(w)
            for _ in range(rnd.randint(0, 3)):
                if c:
                    c[rnd.randrange(len(c))] = "edited" + str(rnd.randint(0, 9))
            texts.append(" ".join(c))
    for _ in range(15):
        texts.append(f"{prose(rnd, rnd.randint(0, 30))} {passage} {prose(rnd, rnd.randint(0, 30))}")
    texts += [None, "", " \n\t ", "one", "ONE", "été à la mer", "x" * 50_000, "a b c d " * 5000, texts[30], texts[30].upper()]
    return list(enumerate(texts))


def classes_by_force(texts, k, num, den):
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(AZ))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("k", "num", "den", "light"), [(4, 85, 100, None), (5, 80, 100, None), (2, 50, 100, 12), (4, 85, 100, 20)])
def test_jaccard_is_exact(spark, corpus, monkeypatch, k, num, den, light):
    if light is not None:
        monkeypatch.setattr(jaccard, "choose_boundary", lambda *a: light)
    got = {r[0]: (r[1], r[2]) for r in jaccard.jaccard_classes(frame(spark, corpus), k, num, den).collect()}
    assert got == classes_by_force(corpus, k, num, den)


def test_jaccard_large_family_in_blocks(spark, monkeypatch):
    rnd = random.Random(9)
    base = prose(rnd, 80).split()
    texts = []
    for i in range(120):
        w = list(base)
        for _ in range(rnd.randint(0, 4)):
            w[rnd.randrange(len(w))] = f"e{rnd.randint(0, 10**6)}"
        texts.append((i, " ".join(w + ["tail"] * (i % 3))))
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 16)
    got = {r[0]: (r[1], r[2]) for r in jaccard.jaccard_classes(frame(spark, texts), 4, 85, 100).collect()}
    assert got == classes_by_force(texts, 4, 85, 100)


def test_jaccard_large_families_are_sent_out_a_few_times(spark):
    members = spark.range(20_000).selectExpr("id AS doc_id", "cast(380 + id % 20 AS bigint) AS n", "0L AS family")
    assert jaccard._blocks(members, 85, 100).selectExpr("sum(size(blocks))").first()[0] <= 10 * 20_000


@pytest.mark.parametrize(("num", "den", "chunk"), [(85, 100, 16), (80, 100, 64), (50, 100, 16)])
def test_jaccard_links_of_a_block(monkeypatch, num, den, chunk):
    rnd = np.random.default_rng(5)
    sets = []
    for _ in range(4):
        base = rnd.integers(0, 1 << 62, 60).astype(np.uint64)
        for i in range(60):
            own = np.where(rnd.random(60) < rnd.choice([0.02, 0.1, 0.3]), rnd.integers(0, 1 << 62, 60).astype(np.uint64), base)
            sets.append(np.unique(own[: 60 - i % 25]))
    rnd.shuffle(sets)
    label = np.arange(len(sets))
    for a, x in enumerate(sets):
        for b in range(a):
            both = len(np.intersect1d(x, sets[b]))
            if both * den >= num * (len(x) + len(sets[b]) - both):
                label[label == label[a]] = label[b]
    want = [int(np.flatnonzero(label == x).min()) for x in label]
    monkeypatch.setattr(jaccard, "CHUNK_ROWS", chunk)
    got = list(range(len(sets)))
    for i, j in zip(*jaccard.link_forest(sets, num, den), strict=True):
        got[i] = int(j)
    assert got == want


def test_jaccard_bounds_change_nothing(spark, corpus, monkeypatch):
    want = classes_by_force(corpus, 5, 80, 100)
    for name, bound in (("MEMBERS_BYTES", 0), ("FREQUENT_MOST", 3)):
        monkeypatch.setattr(jaccard, name, bound)
        assert {r[0]: (r[1], r[2]) for r in jaccard.jaccard_classes(frame(spark, corpus)).collect()} == want


def test_jaccard_boundary_costs():
    assert jaccard.subset_work(6, 85, 100) == 2 and jaccard.subset_work(3, 85, 100) == 1
    assert jaccard.choose_boundary({n: 100 for n in range(1, 25)}, 50.0, 85, 100) >= 5
    assert jaccard.choose_boundary({}, 1.0, 85, 100) == 0


def test_jaccard_keeps_columns_and_one(spark):
    docs = frame(spark, [(3, "a b c d e f g"), (1, "a b c d e f g"), (None, "a b c d e f g"), (2, "other words stand here now"), (5, None), (6, None)])
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.collect() if r["doc_id"]) == [(False, 1), (False, 2), (False, 5), (False, 6)]
    assert jaccard.jaccard_classes(docs.limit(0)).count() == 0


def test_repeated_passages_are_those_of_brute_force(spark, corpus):
    least = 50
    words = {i: [(m.start(), m.end(), m.group().translate(AZ)) for m in re.finditer(r"[^\x20\x09-\x0D]+", t or "")] for i, t in corpus}
    owners = defaultdict(set)
    for i, w in words.items():
        for j in range(len(w) - least + 1):
            owners[tuple(x[2] for x in w[j : j + least])].add(i)
    want, later_most = {}, {}
    for i, w in words.items():
        hit, late = set(), set()
        for j in range(len(w) - least + 1):
            who = owners[tuple(x[2] for x in w[j : j + least])]
            if len(who) > 1:
                hit |= set(range(j, j + least))
                if min(who) < i:
                    late |= set(range(j, j + least))
        if hit:
            want[i], later_most[i] = hit, late
    got = {r["doc_id"]: r for r in suffix.repeated_passages(frame(spark, corpus)).collect()}
    assert set(got) == set(want)
    for i, hit in want.items():
        marks = {j for j, (a, b, _) in enumerate(words[i]) if any(s["start"] <= a and b <= s["stop"] for s in got[i]["spans"])}
        assert marks == hit and got[i]["n_repeated"] == len(hit)
        late = {j for j, (a, b, _) in enumerate(words[i]) if any(s["start"] <= a and b <= s["stop"] for s in got[i]["later_spans"])}
        assert late <= later_most[i]
    # Whatever later spans are removed, each repeated window stays whole in some document.
    assert any(got[i]["n_later"] for i in got)


def test_repeated_passages_of_small_chunks(spark, corpus, monkeypatch):
    whole = {tuple(map(str, r)) for r in suffix.repeated_passages(frame(spark, corpus)).select("doc_id", "n_repeated", "spans").collect()}
    split = {tuple(map(str, r)) for r in suffix.repeated_passages(frame(spark, corpus).repartition(7)).select("doc_id", "n_repeated", "spans").collect()}
    assert whole == split
    monkeypatch.setattr(suffix, "HELD_ROWS", 50)
    assert whole == {tuple(map(str, r)) for r in suffix.repeated_passages(frame(spark, corpus)).select("doc_id", "n_repeated", "spans").collect()}
    monkeypatch.setattr(suffix, "SPOTS_MOST", 0)
    assert whole == {tuple(map(str, r)) for r in suffix.repeated_passages(frame(spark, corpus)).select("doc_id", "n_repeated", "spans").collect()}
    assert suffix.repeated_passages(frame(spark, []).limit(0)).count() == 0


def passages_by_force(texts, least=50):
    """{id: (repeated words, later words)} by all windows of all texts."""
    words = {i: t.split() for i, t in texts}
    holders = defaultdict(set)
    for i, w in words.items():
        for j in range(len(w) - least + 1):
            holders[tuple(w[j : j + least])].add(i)
    out = {}
    for i, w in words.items():
        hit, late = set(), set()
        for j in range(len(w) - least + 1):
            own = holders[tuple(w[j : j + least])]
            hit |= set(range(j, j + least)) if len(own) > 1 else set()
            late |= set(range(j, j + least)) if min(own) < i else set()
        if hit:
            out[i] = (hit, late)
    return out


def marked(text, spans):
    at = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    return {j for j, (a, b) in enumerate(at) if any(s["start"] <= a and b <= s["stop"] for s in spans)}


def test_repeated_passages_of_settled_ranges(spark):
    rnd = random.Random(11)
    p, q, x, y, z, u = (prose(rnd, n) for n in (60, 60, 80, 80, 60, 70))
    # A document's second P is like a part of the range that its first P shares with another one, for either order of ids.
    twice = [(1, f"{x} {p} {y} {z} {p}"), (2, f"{x} {p} {y}"), (3, f"{u} {q} {x[::-1]}"), (4, f"{u} {q} {x[::-1]} {z[::-1]} {q}")]
    # Families of exact copies that share nothing but P, in the larger ones twice in the same surroundings.
    r, a, b, c = (prose(rnd, n) for n in (60, 90, 90, 90))
    copies = [(i, t) for i, t in zip(range(11, 18), [f"{a} {r} {b}"] * 2 + [f"{c} {r} {a[::-1]} {c} {r} {a[::-1]}"] * 3 + [f"{b[::-1]} {r} {c[::-1]}"] * 2, strict=True)]
    texts = [*twice, *copies]
    want = passages_by_force(texts)
    for slices in (1, 7):
        got = {d["doc_id"]: d for d in suffix.repeated_passages(frame(spark, [*texts, (None, texts[0][1])]).repartition(slices)).collect()}
        assert set(got) == set(want)
        for i, t in texts:
            assert (marked(t, got[i]["spans"]), marked(t, got[i]["later_spans"])) == want[i], (i, slices)
            assert (got[i]["n_repeated"], got[i]["n_later"]) == tuple(map(len, want[i]))


def test_later_spans_are_those_of_brute_force(spark, corpus):
    texts = [(i, t.translate(AZ)) for i, t in corpus if t]
    want = passages_by_force(texts)
    got = {d["doc_id"]: d for d in suffix.repeated_passages(frame(spark, texts)).collect()}
    assert set(got) == set(want)
    for i, t in texts:
        if i in want:
            assert (marked(t, got[i]["spans"]), marked(t, got[i]["later_spans"])) == want[i], i


def test_neighbours_over_batches():
    import pyarrow as pa

    def batch(rows):
        k, d, s = zip(*rows, strict=True)
        n = len(rows)
        z = pa.array([0] * n, pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(d, pa.int64()), z, z, z, z, z, pa.array([0] * n, pa.int64()), pa.array(s, pa.int8())], names=["key", "doc_id", "a", "b", "ca", "cb", "pos", "wide", "state"])

    rows = [(1, 1, 0), (1, 1, 0), (1, 2, 0), (2, 5, 0), (3, 4, 2), (3, 4, 0), (4, 1, 0), (4, 1, 0), (5, 1, 0), (5, 2, 0), (6, 9, 2)]
    want = sorted([(1, True, False), (1, True, False), (2, True, True), (5, False, False), (4, True, False), (4, True, False), (1, False, False), (1, False, False), (1, True, False), (2, True, True), (9, True, False)])
    for step in (1, 2, 3, 5, 20):
        out = [x for b in suffix._neighbours(batch(rows[i : i + step]) for i in range(0, len(rows), step)) for x in zip(b.column(1).to_pylist(), b.column(8).to_pylist(), b.column(9).to_pylist(), strict=True)]
        assert sorted(out) == want, step


def test_neighbours_that_wait_for_an_unmatched_run():
    import pyarrow as pa

    names = ["key", "doc_id", "a", "b", "ca", "cb", "pos", "wide", "state"]
    one = lambda *rows: pa.RecordBatch.from_pylist([dict.fromkeys(names, 0) | {"key": k, "doc_id": d} for k, d in rows])
    # The first run ends in the second batch without a match, the next one is matched in the third.
    out = [x for b in suffix._neighbours(iter([one((1, 1)), one((1, 1), (2, 1)), one((2, 2))])) for x in zip(b.column(0).to_pylist(), b.column(8).to_pylist(), strict=True)]
    assert sorted(out) == [(1, False), (1, False), (2, True), (2, True)]


def hits_by_force(texts, items, n=8):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: pattern.findall((t or "").translate(AZ))
    windows = defaultdict(set)
    for item, t in items:
        w = words(t)
        m = min(n, len(w))
        for j in range(len(w) - m + 1 if w else 0):
            windows[tuple(w[j : j + m])].add(str(item))
    out = []
    for i, t in texts:
        w, hit, found = words(t), set(), set()
        for m in {len(x) for x in windows}:
            for j in range(len(w) - m + 1):
                if tuple(w[j : j + m]) in windows:
                    hit |= set(range(j, j + m))
                    found |= windows[tuple(w[j : j + m])]
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2))
    return out


def test_decontamination_by_force(spark, corpus, monkeypatch):
    rnd = random.Random(2)
    items = [(1, "The quick-brown fox! jumps over 13 lazy dogs, again and AGAIN"), (10, "tiny item"), (2, ""), (3, None), (4, corpus[15][1]), (4, "jumps over 13 lazy dogs again and again"), (None, "no id here")]
    texts = [*corpus, (900, "x The quick brown fox jumps over 13 lazy dogs again y TINY, ITEM tiny item"), (901, "Étiny item"), (902, "tiny  item" + prose(rnd, 5)), (900, "tiny item")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(map(repr, hits_by_force(texts, [x for x in items if x[0] is not None])))
    assert sorted(repr(tuple(r)) for r in decontaminate.op9(frame(spark, texts), bench).collect()) == want
    monkeypatch.setattr(decontaminate, "PART_WORDS", 5)
    assert sorted(repr(tuple(r)) for r in decontaminate.op9(frame(spark, texts), bench).collect()) == want


@pytest.mark.parametrize("words", [1_000_000, 1])
def test_decontamination_spans_and_cleaning(spark, monkeypatch, words):
    monkeypatch.setattr(decontaminate, "PART_WORDS", words)
    bench = spark.createDataFrame([(1, "alpha beta gamma"), (2, "delta")], "item_id long, text string")
    docs = frame(spark, [(1, "é x Alpha, beta; GAMMA y delta."), (2, "alpha beta"), (3, None), (4, "")])
    spans = {r[0]: [tuple(s) for s in r[1]] for r in decontaminate.benchmark_hits(docs, bench).select("doc_id", "spans").collect()}
    assert spans == {1: [(4, 22), (25, 30)], 2: [], 3: [], 4: []}
    kept = decontaminate.clean_documents(docs, bench)
    assert kept.columns == docs.columns and sorted(r[0] for r in kept.collect()) == [2, 3, 4]
    cut = decontaminate.clean_documents(docs, bench, span_only=True)
    assert {r[0]: r[1] for r in cut.select("doc_id", "text").collect()} == {1: "é x  y .", 2: "alpha beta", 3: None, 4: ""}
    assert {r["doc_id"]: r["n_chars"] for r in cut.collect()} == {1: 8, 2: 10, 3: 0, 4: 0} and cut.columns == docs.columns
    assert decontaminate.clean_documents(docs, bench.limit(0)).count() == 4
    assert sorted(r[0] for r in decontaminate.clean_documents(docs, bench, least_items=3).collect()) == [1, 2, 3, 4]
    assert decontaminate.op9(docs.limit(0), bench).count() == 0


def spans_by_force(text):
    text = text or ""
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    digits = lambda m: [int(c) for c in m.group() if c in "0123456789"]
    luhn = lambda d: sum(x if i % 2 == 0 else (2 * x if 2 * x < 10 else 2 * x - 9) for i, x in enumerate(reversed(d))) % 10 == 0
    out += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m)) <= 15]
    return out


def test_pii_base_spans_by_force():
    rnd = random.Random(3)
    atoms = ["a.b@c.de", "x@y", "@", ".", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4785380592391139", "4785 3805-9239 1139", "+1 (743) 555-3824", "+", "-", " ", "  ", "é", "٣", "_", "00.01.002.0003", "12", "a", "\n", "(", ")", "%", "+44 20 7946 0958"]
    for _ in range(1500):
        t = "".join(rnd.choice(atoms) for _ in range(rnd.randint(0, 14)))
        assert [(pii.KINDS[k], a, b) for k, a, b in pii.base_spans(t)] == spans_by_force(t), t


def test_pii_query_and_cases(spark):
    long = "word " * 20_000 + "mail a@b.cd now"
    texts = [(1, "a@b.cd 10.0.0.1 +1 (743) 555-3824, 4785380592391139"), (1, "a@b.cd"), (2, None), (None, ""), (3, long), (4, 'token = "f0ddae3b09ae356cbefecdd3232fa5489bb400d6"'), (5, "Version 2.0 of 1999 with 25 items")]
    got = pii.op1(frame(spark, texts)).collect()
    assert len(got) == len(texts)
    by = {(r["doc_id"], r["n_ip"]): r for r in got}
    assert by[1, 1]["spans"].startswith("email:0:6,ip:7:15,card:35:51,phone:16:33")
    assert by[2, 0]["base_sha256"] == hashlib.sha256(b"").hexdigest() and by[2, 0]["spans"] == ""
    assert by[3, 0]["spans"] == f"email:{len(long) - 10}:{len(long) - 4}"
    assert by[4, 0]["spans"] == "secret:9:49" and by[5, 0]["spans"] == ""
    assert pii.op1(frame(spark, []).limit(0)).count() == 0


def test_pii_viterbi_is_the_best_path():
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    move = rng.normal(size=(len(pii.TAGS),) * 2)
    seqs = [rng.normal(size=(n, len(pii.TAGS))) for n in (3, 1, 2, 3)]
    for e, tags in zip(seqs, pii.viterbi(seqs, move), strict=True):
        score = lambda t, e=e: -np.inf if pii._NOT_FIRST[t[0]] or any(pii._BAD[a, b] for a, b in itertools.pairwise(t)) else sum(e[i, x] for i, x in enumerate(t)) + sum(move[a, b] for a, b in itertools.pairwise(t))
        best = max(itertools.product(range(len(pii.TAGS)), repeat=len(e)), key=score)
        assert tuple(tags) == best
    assert pii.viterbi([], move) == []


def test_pii_redacts(spark):
    docs = frame(spark, [(1, "write a@b.cd or +1 (743) 555-3824"), (2, None), (3, "plain")])
    got = {r["doc_id"]: r for r in pii.redact(docs).collect()}
    assert got[1]["text"] == "write [EMAIL] or [PHONE]" and got[1]["n_chars"] == 24
    assert got[2]["text"] is None and got[3]["text"] == "plain" and pii.redact(docs).columns == docs.columns


def test_packing_places_every_word_once(spark, corpus):
    texts = [*corpus, (700, "w " * 9000), (701, "w " * 4095), (702, None), (702, "again"), (None, "x y")]
    rows = packing.pack(frame(spark, texts)).collect()
    want = defaultdict(int)
    for i, t in texts:
        want[i] += len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) + 1
    have = defaultdict(int)
    bins = defaultdict(list)
    for r in rows:
        have[r["doc_id"]] += r["length"]
        bins[r["bin_id"], r["bin_size"]].append((r["bin_offset"], r["bin_offset"] + r["length"]))
    assert have == want
    assert len({b for b, _ in bins}) == len(bins)
    for (_, size), spans in bins.items():
        spans.sort()
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
        assert spans[-1][1] <= size and (size == 512 or spans[-1][1] > size // 2)
    assert packing.pack(frame(spark, []).limit(0)).count() == 0


def packed_by_force(lengths, sizes, overhead):
    """Sorted bins (size, sorted contents), by placing one item after the other into plain lists: the tightest open bin, of
    several the one that was filled last, or
    where none fits a batch of new ones of the size of least cost a token, filled ahead by the longest items left."""
    left = sorted(lengths, reverse=True)
    bins = []

    def ahead(size, first, rest):
        used = first
        for x in rest:
            if used + x <= size:
                used += x
        return used

    while left:
        x = left[0]
        open_bins = [b for b in bins if b[0] >= x]
        if not open_bins:
            size = min((s for s in sizes if s >= x), key=lambda s: ((s + overhead) / ahead(s, x, left[1:]), s))
            n, each = left.count(x), size // x
            many = -(-n // each) if n < 4 * each else max(1, n // each // 4)
            bins += [[size, [], 0] for _ in range(many)]
            continue
        b = min(open_bins, key=lambda b: (b[0], -b[2]))
        b[0] -= x
        b[1].append(x)
        b[2] = len(lengths) - len(left) + 1
        left.pop(0)
    return sorted((next(s for s in sorted(sizes) if s >= sum(items)), sorted(items)) for _, items, _ in bins if items)


def test_packing_plan_is_that_of_single_items():
    rnd = random.Random(4)
    for sizes, most in (((8, 16, 32), 32), ((512, 1024, 2048, 4096), 4096), ((10,), 10)):
        for _ in range(25):
            lengths = [rnd.choice([rnd.randint(1, most), rnd.randint(1, max(2, most // 8)), most // 3 + 1]) for _ in range(rnd.randint(0, 60))]
            counts = defaultdict(int)
            for x in lengths:
                counts[x] += 1
            plan = packing.plan(dict(counts), sizes, 2)
            got = sorted((size, sorted(length for length, n in items for _ in range(n))) for size, many, items in plan for _ in range(many))
            assert got == packed_by_force(lengths, sizes, 2)


def test_packing_plan_fills_well():
    rnd = random.Random(1)
    counts = defaultdict(int)
    for _ in range(20_000):
        counts[min(4096, max(1, int(rnd.lognormvariate(5.5, 1.2))))] += 1
    plan = packing.plan(dict(counts))
    placed = defaultdict(int)
    for size, many, items in plan:
        assert sum(length * n for length, n in items) <= size
        for length, n in items:
            placed[length] += n * many
    assert placed == counts
    capacity = sum(size * many for size, many, _ in plan)
    assert sum(length * n for length, n in counts.items()) / capacity > 0.97
    assert packing.plan({}) == []


def test_language_is_held_out_accurate(spark):
    rnd = random.Random(4)
    sounds = {"aa": "ka mo ti ru sa ne".split(), "bb": "sch pf ung keit ber ein".split(), "cc": "eau oi tion re que é".split()}
    say = lambda k: " ".join("".join(rnd.choice(sounds[k]) for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(8, 40)))
    rows = [(i, say(k), k) for i, k in enumerate(rnd.choice("abc") * 2 for _ in range(400))]
    extra = [(1000, None, "aa"), (1001, "123 !!", "aa"), (1002, "", "bb"), (None, "ka mo ti", "aa"), (1003, "ka mo", None), (5, "ka mo ti ru sa ne", "aa"), (1004, "中文", None)]
    docs = spark.createDataFrame([(i, t, k, "s", 1) for i, t, k in rows + extra], "doc_id long, text string, lang string, source string, score int")
    got = langid.op5(docs).collect()
    assert len(got) == 407 and all(0 <= r["score"] <= 1 for r in got)
    truth = {i: k for i, _, k in rows}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 40 and sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.97
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3 and by[1000]["score"] == 0
    assert by[1004]["lang_pred"] in sounds
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"] if r["doc_id"] is not None else "").encode()) % 5 == 0) for r in got)
    none = langid.op5(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in none} == {"und"} and langid.op5(docs.limit(0)).count() == 0


def test_temperature_sharpens_and_softens():
    import numpy as np

    rng = np.random.default_rng(1)
    gold = rng.integers(0, 3, 500)
    logits = np.eye(3)[np.where(rng.random(500) < 0.7, gold, (gold + 1) % 3)]
    assert langid.temperature(logits * 20, gold) > 5 and langid.temperature(logits * 0.1, gold) < 0.5
    assert langid.temperature(logits[:0], gold[:0]) == 1.0


def test_quality_separates_junk(spark):
    rnd = random.Random(6)
    the = lambda n: " ".join(rnd.choice(["the", "of", "and", prose(rnd, 1), prose(rnd, 1), prose(rnd, 1) + "."]) for _ in range(n))
    good = [the(rnd.randint(25, 200)) for _ in range(150)] + [the(4) for _ in range(10)]
    junk = [" ".join(w.upper() + "!!" for w in prose(rnd, 60).split()) for _ in range(12)] + [" ".join(w + "%%%" for w in prose(rnd, 60).split()) for _ in range(12)] + [" | ".join(prose(rnd, 60).split()) for _ in range(12)]
    docs = frame(spark, [*enumerate(good + junk), (900, None), (901, ""), (None, good[0]), (0, good[0])])
    got = quality.op7(docs).collect()
    assert len(got) == len(good) + len(junk) + 4
    by = {r["doc_id"]: r["accepted"] for r in got}
    assert sum(by[i] for i in range(len(good))) >= len(good) - 3
    assert sum(by[i] for i in range(len(good), len(good) + len(junk))) <= 3
    assert not by[900] and not by[901]
    kept = quality.accepted_documents(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["accepted"] for r in got)
    assert quality.op7(docs.limit(0)).count() == 0 and quality.op7(docs.filter("text is null")).count() == 1


def test_quality_learns_from_its_whole_sample():
    import inspect

    for f in (quality.train, quality.score_documents, quality.accepted_documents):
        assert inspect.signature(f).parameters["sample"].default == 4000


def test_quality_posteriors_and_scores_by_force(spark):
    import math

    import numpy as np

    rnd = random.Random(3)
    texts = [(i, " ".join(rnd.choice(["the", "of", prose(rnd, 1), prose(rnd, 1) + "."]) for _ in range(rnd.randint(1, 60))) if i % 6 else " | ".join(prose(rnd, 30).upper().split())) for i in range(120)]
    texts += [(200, "the word " * 30_000), (201, texts[1][1])]
    # Expectation-maximisation, a text at a time, in plain loops.
    rows = [quality.votes(quality.statistics(quality.T.Words(*quality.T.utf8(quality.pa.array([t])), quality.T.BLANK_WORD)))[0].tolist() for _, t in texts]
    prior, table = 0.8, {1: [[0.1, 0.9]] * 8, 0: [[0.6, 0.4]] * 8}
    good = [0.0] * len(rows)
    for _ in range(100):
        new = []
        for v in rows:
            p = {c: math.prod([q, *(table[c][j][x] for j, x in enumerate(v) if x >= 0)]) for c, q in ((0, 1 - prior), (1, prior))}
            new.append(p[1] / (p[0] + p[1]))
        done = max(abs(a - b) for a, b in zip(new, good, strict=True)) < 1e-9
        good = new
        for c, start in ((0, (4.0, 1.0)), (1, (0.5, 4.0))):
            table[c] = []
            for j in range(8):
                n = list(start)
                for v, g in zip(rows, good, strict=True):
                    if v[j] >= 0:
                        n[v[j]] += g if c else 1 - g
                table[c].append([x / sum(n) for x in n])
        prior = min(0.98, max(0.02, (sum(good) + 2) / (len(rows) + 4)))
        if done:
            break
    codes, n = np.unique(quality.pattern(np.array(rows)), return_counts=True)
    got, own, share = quality.posteriors(codes, n.astype(float))
    assert share == pytest.approx(prior, abs=1e-6)
    assert got[np.searchsorted(codes, quality.pattern(np.array(rows)))] == pytest.approx(np.array(good), abs=1e-6)
    assert own[1] == pytest.approx(np.array(table[1]), abs=1e-6)
    # The scores are the logistic function of the trained weights and a whole text's features; sums of 32-bit numbers in
    # training differ a little from run to run.
    docs = frame(spark, texts)
    w = quality.train(docs)
    for r in quality.op7(docs).collect():
        t = dict(texts)[r["doc_id"]]
        x = next(quality._vectors(*quality.T.utf8(quality.pa.array([t]))))
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-float(x @ w))), abs=1e-3) and r["accepted"] == (r["score"] >= 0.5)


def test_quality_em_learns_accuracies():
    import numpy as np

    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.85
    right = np.array([0.95, 0.9, 0.9, 0.85, 0.95, 0.9, 0.9, 0.8])
    v = np.where(rng.random((20_000, 8)) < right, truth[:, None], ~truth[:, None]).astype(int)
    v[rng.random(v.shape) < 0.3] = -1
    codes, at, n = np.unique(quality.pattern(v), return_inverse=True, return_counts=True)
    good, table, prior = quality.posteriors(codes, n.astype(float))
    assert abs(prior - 0.85) < 0.03 and np.abs(table[1, :, 1] - right).max() < 0.05
    assert ((good[at] > 0.5) == truth).mean() > 0.97
    assert (quality.unpattern(codes)[at] == v).all()


def test_pii_decodes_as_if_everywhere(corpus):
    rnd = random.Random(12)
    atoms = ["token", "=", '"', "0f9e8d7c6b5a49382716", "password:", "(743) 555-3824", "word", "Word", "2001:0db8:0:0:85a3:8a2e:0370:7334", "mail", "x @ y.org", ".", "4785.3805.9239.1139", "12", "é", "_", "中文", "\n"]
    texts = [t or "" for _, t in corpus] + [" ".join(rnd.choice(atoms) for _ in range(rnd.randint(0, 60))) for _ in range(300)]
    field = pii.trained()
    got = pii.all_spans(texts, field)
    assert got == pii.all_spans(texts, field, everywhere=True)
    assert any(more for _, more in got)
    assert got == [pii.all_spans([t], field)[0] for t in texts]
    for t, (_, more) in zip(texts, got, strict=True):
        assert all(pii._valid(k, t[a:b]) for k, a, b in more)


def test_pii_checks_of_added_spans():
    k = pii.KINDS.index
    assert pii._valid(k("card"), "4785.3805.9239.1139") and not pii._valid(k("card"), "4785.3805.9239.1138")
    assert pii._valid(k("ip"), "2001:0db8:85a3:0:0:8a2e:0370:7334") and not pii._valid(k("ip"), "1.2.3.256") and not pii._valid(k("ip"), "12:30")
    assert pii._valid(k("phone"), "743 555 3824") and not pii._valid(k("phone"), "12 34")
    assert pii._valid(k("email"), "a @ b.org") and not pii._valid(k("email"), "a.org") and not pii._valid(k("secret"), "a1b2")


def test_pii_finds_secrets_without_digits():
    text = 'The door was open. password = "openthegateplease" and then they left the house.'
    _, more = pii.all_spans([text], pii.trained())[0]
    assert [(pii.KINDS[k], text[a:b]) for k, a, b in more] == [("secret", "openthegateplease")]


def test_language_grams_are_those_of_characters():
    from collections import Counter

    import numpy as np

    def by_force(text):
        t = re.sub(r" +", " ", " " + "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text) + " ")
        return Counter(t[i : i + n] for n in range(1, langid.ORDERS + 1) for i in range(len(t) - n + 1))

    for text in ("Ünïcode Straße 42!", "中文测试", "Привет, мир", "a", "𐐷𝔘b x", "И" * 40_000, "the cat the dog"):
        slots, counts = langid.grams(text.encode())
        want = by_force(text)
        assert counts.sum() == sum(want.values()) and len(slots) <= len(want)
        # Grams share a slot only by chance.
        assert len(slots) >= len(want) - 1 and sorted(counts)[-1] >= max(want.values())
    assert langid.grams(b"12 .,!") is None and langid.grams(b"") is None
    assert langid.grams("ПРИВЕТ".encode())[0].tolist() == langid.grams("привет".encode())[0].tolist()
    assert isinstance(langid.unit(np.array([1]), np.array([2.0]), np.ones(langid.WIDTH)), np.ndarray)


def test_language_of_other_scripts(spark):
    rnd = random.Random(7)
    alphabets = {"ru": "авеикнорстлмдпу", "zh": "的一是不了人我在有他这中大来上", "ja": "のにはをたがでてとしれさあいう", "el": "αβγδεικλμνοπρσ"}
    say = lambda k, n: "".join(rnd.choice(alphabets[k]) + (" " if k in ("ru", "el") and rnd.random() < 0.2 else "") for _ in range(n))
    rows = [(i, say(k, rnd.randint(5, 80)), k) for i, k in enumerate(rnd.choice(list(alphabets)) for _ in range(200))]
    rows.append((5000, say("zh", 200_000), None))
    docs = spark.createDataFrame([(i, t, k, "s", 1) for i, t, k in rows], "doc_id long, text string, lang string, source string, order int")
    got = {r["doc_id"]: r for r in langid.op5(docs).collect()}
    assert sum(got[i]["lang_pred"] == k for i, _, k in rows[:200]) >= 198 and got[5000]["lang_pred"] == "zh"


def test_language_sample_is_that_of_least_hashes(spark):
    rows = [(i, "x", "ab"[i % 7 == 0]) for i in range(6000)] + [(3, "y", "a"), (None, "z", "a")]
    known = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    own = {}
    for r in known.select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).collect():
        own.setdefault(r["lang"], []).append((r["h"], -1 if r["doc_id"] is None else r["doc_id"]))
    want = {(i, k) for k, v in own.items() for _, i in sorted(v)[:50]}
    assert {(-1 if r[0] is None else r[0], r[1]) for r in langid._sample(known, 50).collect()} == want
