"""Line dedup, near dedup, repeated substrings and decontamination against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from rillflow.llm import decontam, joins, linededup, neardup, suffix, textarrays
from rillflow.llm.queries import ORACLE_SQL, QUERIES
from rillflow.llm.scratch import store
from rillflow.llm.textarrays import mix64

from ..oracle import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_twin(spark, name):
    same(spark, SF, QUERIES[name], ORACLE_SQL[name])


def lines_brute(docs, least):
    sites, first = collections.defaultdict(set), {}
    for d, t, s in sorted({(d, t, s) for d, t, s in docs if t is not None}, key=lambda x: (x[0] is not None, x[0])):
        for i, line in enumerate(t.split("\n")):
            if key := line.strip(" \t\r"):
                sites[key] |= {s} - {None}
                first.setdefault(key, (d, i))
    out = []
    for d, t, _ in docs:
        keys = [(x, x.strip(" \t\r")) for x in t.split("\n")] if t is not None else []
        gone = [bool(k) and len(sites[k]) >= least and first[k] != (d, i) for i, (_, k) in enumerate(keys)]
        out.append((d, None if t is None else "\n".join(x for (x, _), g in zip(keys, gone, strict=True) if not g), sum(bool(k) for _, k in keys), sum(gone)))
    return sorted(out, key=repr)


def test_lines(spark):
    rng = random.Random(1)
    docs = [(i, "\n".join(rng.choice(["a", " a ", "b\r", "c", "", "d d", f"own {i}", f"u{rng.randint(0, 40)}"]) for _ in range(rng.randint(0, 6))), rng.choice([*"pqrstuvwxyz", None])) for i in range(120)]
    docs += [(900, None, "p"), (901, "", "q"), (902, "\n\n", None), (5, docs[5][1], docs[5][2])]
    df = spark.createDataFrame([(*d, "extra") for d in docs], "doc_id long, text string, source string, n_removed string")
    for least in (3, 9):
        got = linededup.remove_boilerplate(df, min_sites=least).select("doc_id", "text", "n_lines", "n_removed").collect()
        assert sorted(map(tuple, got), key=repr) == lines_brute(docs, least)
    assert linededup.remove_boilerplate(df.limit(0)).count() == 0


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def groups_brute(docs, width, percent):
    sets = [(d, shingles(t, width)) for d, t in docs]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = collections.defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for x in s:
            where[x].append(i)
    for i, (d, s) in enumerate(sets):
        for j, k in collections.Counter(j for x in s for j in where[x] if j < i).items():
            if 100 * k >= percent * (len(s) + len(sets[j][1]) - k):
                a, b = find(d), find(sets[j][0])
                parent[max(a, b)] = min(a, b)
    return sorted((d, len(s), find(d), find(d) == d) for d, s in sets)


def test_near_duplicates_on_the_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted(map(tuple, QUERIES["op8_minhash_near_dedup"](spark, SF).collect()))
    assert got == groups_brute(docs, 3, 85)


@pytest.mark.parametrize(("percent", "width"), [(85, 3), (80, 5)])
def test_near_duplicates_on_documents(spark, percent, width):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = sorted(map(tuple, neardup.near_duplicates(docs, percent=percent, width=width).collect()))
    assert got == groups_brute([(r.doc_id, r.text) for r in docs.collect()], width, percent)


def test_near_duplicates_of_borderline_copies(spark, monkeypatch):
    """Copies of one text with a tenth of the words changed, most of which are just not similar, with salted joins."""
    monkeypatch.setattr(joins, "LEAST_ROWS", 20)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(120)]
    docs = []
    for i in range(500):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(120)] = word()
        docs.append((i, " ".join(w)))
    docs += [(500 + i, docs[7][1]) for i in range(100)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, neardup.near_duplicates(df).collect())) == groups_brute(docs, 5, 80)


def test_near_duplicates_of_very_long_texts(spark):
    rng = random.Random(9)
    long = [f"w{rng.randrange(10**6)}" for _ in range(300_000)]
    docs = [(1, " ".join(long)), (2, " ".join(long[:290_000])), (3, " ".join(long[:200_000])), (4, "x" * 2_000_000), (5, "x" * 2_000_000), (6, "short text")]
    df = spark.createDataFrame([(*d, True) for d in docs], "doc_id long, text string, kept boolean")
    got = sorted((r.doc_id, r.component_id) for r in neardup.near_duplicates(df).collect())
    assert got == [(1, 1), (2, 1), (3, 3), (4, 4), (5, 4), (6, 6)]


@pytest.mark.parametrize("bits", [neardup.ID_BITS, 1 << 6])
def test_sets_shuffle_few_texts(spark, monkeypatch, bits):
    """Texts whose sets aren't needed are left out before the shuffle, and no needed one is lost, however many share a bit."""
    monkeypatch.setattr(neardup, "ID_BITS", bits)
    docs = spark.createDataFrame([(None if i == 5 else i - 1500, f"a b c d e {i % 2900}") for i in range(3000)], "doc_id long, text string").repartition(3)
    needed = docs.where("doc_id % 60 = 0").select("doc_id").distinct()
    left = neardup._maybe_needed(docs, needed)
    assert left.columns == docs.columns
    assert {r.doc_id for r in needed.collect()} <= {r.doc_id for r in left.collect()}
    assert bits < 1 << 20 or left.count() <= 60
    assert neardup._maybe_needed(docs, needed.limit(0)).isEmpty()
    texts = neardup._needed_texts(docs, needed)
    plan = texts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("doc_id#") < plan.index("_block#") and plan.index("strategy=merge") < plan.index("_block#")
    want = sorted((r.doc_id, r.text) for r in docs.where("doc_id % 60 = 0").collect())
    assert sorted(map(tuple, texts.collect())) == want
    assert sorted(r.doc for r in neardup._sets(docs, needed, 5).collect()) == [d for d, _ in want]


def test_salted_join(spark, monkeypatch):
    monkeypatch.setattr(joins, "LEAST_ROWS", 5)
    left = spark.createDataFrame([(k, i) for k in range(4) for i in range([1, 5, 6, 90][k])], "k long, v long")
    right = spark.createDataFrame([(k, k * 10) for k in range(1, 5)], "k long, w long")
    assert sorted(r.k for r in joins.hot_keys(left, "k").collect()) == [2, 3]
    want = sorted(map(tuple, left.join(right, "k").collect()))
    hot = joins.hot_keys(left, "k")
    assert sorted(map(tuple, joins.salted_join(left, right, "k", hot, spread="v").collect())) == want
    assert joins.salted_join(left, right, "k", hot, spread="v", how="left").count() == left.count()
    assert joins.hot_keys(left.limit(5), "k") is None


def test_components_in_steps(spark):
    """Chains, stars and cycles whose links come in three parts, against union and find."""
    rng = random.Random(7)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(90)]
    links = [(a, b) for a, b in links if a != b]
    rng.shuffle(links)
    parent = {x: x for e in links for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    known = None
    for part in (links[:50], links[50:130], links[130:]):
        known = neardup.connect(known, store(spark.createDataFrame(part, "a long, b long"), "test"))
    assert sorted(map(tuple, known.collect())) == sorted((x, find(x)) for x in parent)
    assert neardup.connect(None, None) is None and neardup.connect(known, None) is known


def test_near_duplicates_in_large_nodes(spark, monkeypatch):
    """A hot passage, a large group of edited copies and chains, with nodes small enough to use every way of comparing."""
    monkeypatch.setattr(neardup, "SMALL_NODE", 3)
    monkeypatch.setattr(neardup, "DEPTH", 2)
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(60)]
    docs = [(0, " ".join(base))]
    for i in range(1, 120):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(60)] = word()
        docs.append((i, " ".join(w[: rng.choice([60, 60, 54])])))
    passage = " ".join(word() for _ in range(25))
    docs += [(200 + i, " ".join(word() for _ in range(30)) + " " + passage) for i in range(60)]
    docs += [(300, None), (301, ""), (302, " \n"), (303, "A b"), (304, "a B"), (305, docs[7][1].upper()), (306, "one")]
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, component_id string").repartition(4)
    got = sorted(map(tuple, neardup.near_duplicates(df, percent=85, width=3).collect()))
    assert got == groups_brute(docs, 3, 85)


def test_batches_of_long_lists_stay_small(monkeypatch):
    """A full Arrow batch of documents whose prefixes go along whole, and one of full nodes; nothing is lost."""
    taken = []

    class Frame:
        def __getattr__(self, name):
            return self

        def __call__(self, *args):
            return self

        def mapInArrow(self, run, schema):
            taken.append(run)
            return self

    rng = np.random.default_rng(5)
    n, width = 5000, 300
    shingles = np.sort(rng.integers(-(1 << 63), (1 << 63) - 1, (n // 2, width)), axis=1).repeat(2, axis=0)
    sets = pa.record_batch({"doc": pa.array(np.arange(n)), "shingles": pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(shingles.ravel()))})
    counts = np.bincount(neardup._bucket(shingles.ravel()), minlength=neardup.COUNT_BUCKETS)
    monkeypatch.setattr(neardup, "_shingle_counts", lambda sets: counts)
    frame = Frame()
    monkeypatch.setattr(Frame, "value", counts, raising=False)
    neardup._prefixes(frame, 80)
    out = list(taken.pop()(iter([sets])))
    assert max(b.get_total_buffer_size() for b in out) < 8 << 20
    got = pa.Table.from_batches(out).combine_chunks()
    for d in (0, 1, 109, 2500, n - 1):
        rows = got.filter(pa.array(got["doc"].to_numpy() == d)).to_pylist()
        want = sorted(shingles[d].tolist(), key=lambda x: (counts[neardup._bucket(np.array([x]))[0]], x))[: width - 240 + 1]
        assert [r["shingle"] for r in rows] == want and all(r["prefix"] == want and r["n"] == width for r in rows)
        assert [r["rest"] for r in rows] == list(range(width, 239, -1))
    assert got.num_rows == n * 61

    m, nodes = neardup.SMALL_NODE, 2000
    low = rng.integers(0, 256, (nodes * m, 64), dtype=np.uint8)
    low[m * 999 + 3] = low[m * 999 + 40]
    ids = np.arange(nodes * m)
    items = pa.StructArray.from_arrays([pa.array(ids), pa.array(np.full(nodes * m, 9)), pa.nulls(nodes * m, pa.int64()), pa.array([x.tobytes() for x in low])], ["doc", "n", "colour", "bytes"])
    lists = pa.record_batch({"members": pa.ListArray.from_arrays(pa.array(np.arange(nodes + 1, dtype=np.int32) * m), items)})
    monkeypatch.setattr(neardup.F, "collect_list", lambda c: frame)
    monkeypatch.setattr(neardup.F, "struct", lambda *c: frame)
    neardup._agreeing_in_nodes(frame, 80)
    assert [r for b in taken.pop()(iter([lists])) for r in b.to_pylist()] == [{"a": m * 999 + 3, "b": m * 999 + 40}]
    assert max(len(p.column("members").flatten()) for p in neardup._pieces(lists, "members")) <= neardup.PIECE
    odd = pa.record_batch({"x": pa.array([[], [1] * 9, [2], [3] * 3, []])})
    assert [p.num_rows for p in neardup._pieces(odd, "x", 4)] == [1, 1, 3] and not list(neardup._pieces(odd.slice(0, 0), "x", 4))


def test_near_duplicates_odd_rows(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "A b c d e f")], "doc_id long, text string")
    got = sorted(map(tuple, neardup.near_duplicates(df).collect()), key=repr)
    assert got == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 2, None, True)]
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def repeats_brute(docs, length):
    seen = collections.Counter(b[i : i + length] for _, t in docs for b in [(t or "").encode()] for i in range(len(b) - length + 1))
    out = []
    for d, t in docs:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(b) else 0
        out.append((d, len(b), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("length", [20, 31])
def test_repeats(spark, monkeypatch, length):
    monkeypatch.setattr(suffix, "BUCKET_ROWS", 200)
    rng = random.Random(3)
    rnd = lambda n: "".join(rng.choice("abcdefghé ") for _ in range(n))
    base = [rnd(rng.randint(0, 120)) for _ in range(10)]
    docs = [(i, "".join(rng.choice([rnd(rng.randint(0, 30)), rng.choice(base)[rng.randint(0, 20) :]]) for _ in range(rng.randint(0, 6)))) for i in range(120)]
    docs += [(900, None), (901, ""), (902, "a" * 200), (903, "ab" * 90), (904, docs[3][1]), (None, docs[5][1]), (3, docs[3][1]), (905, rnd(19))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = suffix.remove_repeats(df, length=length).selectExpr("doc_id", "n_bytes", "n_removed", "n_spans", "sha2(kept, 256)").collect()
    assert sorted(map(tuple, got), key=repr) == repeats_brute(docs, length)
    assert suffix.remove_repeats(df.limit(0)).count() == 0


def test_multikey_sort():
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 5, 300), rng.integers(0, 5, 300)
    order, equal = suffix.multikey_sort([a, b])
    rows = list(zip(a[order].tolist(), b[order].tolist(), strict=True))
    assert rows == sorted(zip(a.tolist(), b.tolist(), strict=True))
    assert equal.tolist() == [False] + [x == y for x, y in zip(rows[1:], rows, strict=False)]


def test_decontamination_recall(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    texts = {r.item_id: " ".join(words(r.text)) for r in items.collect()}
    want = {r.doc_id: {i for i, t in texts.items() if t in " ".join(words(r.text))} for r in docs.collect()}
    got = {r.doc_id: set(r["items"]) for r in QUERIES["op2_decontamination"](spark, SF).collect()}
    hits = sum(len(v) for v in want.values())
    assert hits and sum(len(v & got[d]) for d, v in want.items()) >= 0.9 * hits
    assert sum(bool(got[d] - v) for d, v in want.items()) <= 0.02 * len(want)


def test_decontamination_paraphrase_and_odd_rows(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    item = [word() for _ in range(30)]
    filler = lambda n: [word() for _ in range(n)]
    docs = [(1, " ".join(filler(50) + item + filler(50))), (2, " ".join(filler(40) + [w.upper() + "," for w in item])), (3, " ".join(filler(100))), (4, None), (5, ""), (6, " ".join(item[:8] + filler(60))), (1, "again")]
    df = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, items int")
    bench = spark.createDataFrame([(7, " ".join(item)), (8, None), (9, "..."), (None, "x y")], "item_id long, text string")
    got = sorted((r.doc_id, r.text == "again", list(r["items"])) for r in decontam.find_items(df, bench).collect())
    assert got == [(1, False, [7]), (1, True, []), (2, False, [7]), (3, False, []), (4, False, []), (5, False, []), (6, False, [])]
    assert all(not r["items"] for r in decontam.find_items(df, bench.limit(0)).collect())
    assert decontam.find_items(df.limit(0), bench).count() == 0
    assert decontam.common_subsequence({1: 0b1001, 2: 0b10, 3: 0b100}, 4, [1, 9, 3, 2, 1]) == 3


def held_brute(text, item):
    """Whether the words of a short text hold most of the item as a common subsequence; the rule by answer words is left out."""
    masks = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << i
    return decontam.common_subsequence(masks, len(item), text) >= decontam.COPY_SHARE * len(item)


def test_decontamination_recall_with_many_items(spark):
    """2,000 items of a common vocabulary, each in a text of its own, verbatim or with a fifth of the words changed, against brute force."""
    rng = np.random.default_rng(6)
    vocabulary = np.array(["".join(rng.choice(list("abcdefghijklmnop"), 7)) for _ in range(4000)])
    odds = 1 / np.arange(20, 4020)
    some = lambda n: rng.choice(vocabulary, n, p=odds / odds.sum()).tolist()
    items = [some(int(rng.integers(15, 60))) for _ in range(2000)]
    texts = []
    for i, item in enumerate(items):
        held = list(item)
        if i % 2:
            for k in rng.choice(len(item), len(item) // 5, replace=False):
                held[k] = some(1)[0]
        texts.append(some(int(rng.integers(0, 60))) + held + some(int(rng.integers(20, 60))))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, i) for r in decontam.find_items(docs, bench).collect() for i in r["items"]}
    want = {(d, i) for d, t in enumerate(texts) for i in range(len(items)) if (i == d or len(set(items[i]) & set(t)) >= 0.5 * len(set(items[i]))) and held_brute(t, items[i])}
    assert len(want) >= 2000 and len(want - got) <= 0.001 * len(want)
    assert len(got - want) <= 0.02 * len(want)


@pytest.mark.parametrize("m", [1, 2, 5, 8, 12, 13, 80, 81, 500])
def test_decontamination_of_short_and_long_items(spark, m):
    """Items of ``m`` words, verbatim and at any place of longer texts."""
    rng = np.random.default_rng(m)
    vocabulary = np.array(["".join(rng.choice(list("abcdefghijklmnop"), 7)) for _ in range(4000)])
    odds = 1 / np.arange(20, 4020)
    some = lambda n: rng.choice(vocabulary, n, p=odds / odds.sum()).tolist()
    items = [some(m) for _ in range(60)]
    rows = []
    for i in range(180):
        t, p = some(400), int(rng.integers(401))
        rows.append((i, " ".join(t[:p] + items[i % 60] + t[p:])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    got = {r.doc_id: r["items"] for r in decontam.find_items(docs, bench).collect()}
    assert [i for i in range(180) if i % 60 not in got[i]] == []


@pytest.mark.parametrize("m", [8, 16, 40, 100, 200])
def test_decontamination_of_paraphrases(spark, m):
    """Items with two fifths of their common words exchanged and words put between, the rare ones kept: at least 0.9 are found."""
    rng = np.random.default_rng(m)
    vocabulary = np.array(["".join(rng.choice(list("abcdefghijklmnop"), 7)) for _ in range(4000)])
    odds = 1 / np.arange(20, 4020)
    some = lambda n: rng.choice(vocabulary, n, p=odds / odds.sum()).tolist()
    items, rows = [], []
    for i in range(100):
        item = some(m)
        rare = rng.choice(m, max(1, min(6, m // 4)), replace=False)
        for j, k in enumerate(rare):
            item[k] = f"name{i}x{j}"
        items.append(item)
        said = []
        for k, w in enumerate(item):
            said += [some(1)[0] if k not in rare and rng.random() < 0.4 else w] + some(int(rng.random() < 0.1))
        t, p = some(300), int(rng.integers(301))
        rows.append((i, " ".join(t[:p] + said + t[p:])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    got = {r.doc_id: r["items"] for r in decontam.find_items(docs, bench).collect()}

    # the rule itself on each whole text, with the corpus's own weights
    weight, _ = decontam.corpus_statistics(docs)
    hashed = lambda texts: [decontam._word_hashes(x)[0] for t in texts for x in decontam._lower_slabs(pa.array([t]))]
    rules = [decontam.masks_and_answers(w, weight) for w in hashed([" ".join(t) for t in items])]
    held = lambda i: decontam.is_held(*rules[i], m, hashed([rows[i][1]])[0].tolist())
    want = [i for i in range(100) if held(i)]
    assert len(want) >= 50
    assert sum(i in got[i] for i in want) >= 0.9 * len(want)
    assert sum(bool(set(got[i]) - {i}) for i in range(100)) <= 2


def test_decontamination_basis_is_of_all_passages(spark):
    """More passages than any sample had: counts and the product of the basis are those of every passage, repeated ones too."""
    rng = np.random.default_rng(11)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.3, int(rng.integers(1, 40))) % 3000) for _ in range(7000)]
    docs = spark.createDataFrame([(t,) for t in [*texts, *texts[:50], "", None]], "text string").repartition(5)
    weight, n = decontam.corpus_statistics(docs)
    start = decontam.range_finder()
    got = decontam.corpus_product(docs, weight, start)
    want, seen = np.zeros(start.shape), 0
    for t in [*texts, *texts[:50]]:
        h = decontam._word_hashes(next(iter(decontam._lower_slabs(pa.array([t])))))[0]
        for i in range(0, len(h), decontam.PASSAGE):
            f, times = np.unique(decontam._feature(h[i : i + decontam.PASSAGE]), return_counts=True)
            v = times * weight[f].astype(float)
            v /= max(1e-9, np.linalg.norm(v))
            want[f] += v[:, None] * (v @ start[f])
            seen += 1
    assert n == seen > 8192
    assert np.abs(got - want).max() <= 1e-4 * np.abs(want).max()
    basis = decontam.latent_basis([decontam._word_hashes(next(iter(decontam._lower_slabs(pa.array(["w1 w2 w3"])))))[0]], weight, start, got, n)
    assert basis.flags.c_contiguous and np.abs(basis.T @ basis - np.eye(basis.shape[1])).max() < 1e-3


def test_decontamination_prefilter_is_implied():
    """The count of a stretch's words that are the item's is never below the common subsequence, also with repeated words."""
    rng = np.random.default_rng(3)
    items = [rng.integers(0, 6, int(rng.integers(1, 12))).astype(np.uint64) for _ in range(40)]
    items = [mix64(w) for w in items]
    held = decontam._held_bits(items)
    h = mix64(rng.integers(0, 9, 500).astype(np.uint64))
    lo = rng.integers(0, 400, 200)
    hi, item = lo + rng.integers(0, 60, 200), rng.integers(0, 40, 200)
    got = decontam._words_held(h, lo, hi, item, held, step=7)
    for a, b, k, n in zip(lo, hi, item, got, strict=True):
        assert n >= sum(int(x) in set(items[k].tolist()) for x in h[a:b])
        masks = {}
        for i, w in enumerate(items[k].tolist()):
            masks[w] = masks.get(w, 0) | 1 << i
        assert decontam.common_subsequence(masks, len(items[k]), h[a:b].tolist()) <= n


def test_decontamination_bounds_of_many_candidates():
    """Subsequences of candidates side by side equal those of one at a time, and answer words are never undercounted."""
    rng = np.random.default_rng(4)
    known = rng.integers(0, 1 << 63, 14).astype(np.uint64)
    items = [known[rng.integers(0, 12, m)] for m in (1, 2, 7, 31, 63, 64, 65, 200, *rng.integers(1, 65, 30))]
    weight = rng.random(decontam.FEATURES)
    masks, answers = zip(*(decontam.masks_and_answers(w, weight) for w in items), strict=True)
    h = known[rng.integers(0, 14, 600)]
    h[100:164] = items[5]
    lo = np.r_[100, rng.integers(0, 400, 300)]
    hi, item = lo + np.r_[64, rng.integers(1, 200, 300)], np.r_[5, rng.integers(0, len(items), 300)]
    sizes = np.array([len(w) for w in items])
    seen = decontam._answers_seen(h, lo, hi, item, decontam._answer_bits(answers), step=7)
    for a, b, k, n in zip(lo, hi, item, seen, strict=True):
        assert n >= len(answers[k].intersection(h[a:b].tolist()))
    short = np.flatnonzero(sizes[item] <= 64)
    lo, hi, item = lo[short], hi[short], item[short]
    got = decontam._common_lengths(h, lo, hi, item, sizes[item], decontam._held_bits(items), decontam._masks_of_words(items), step=7)
    assert got.tolist() == [decontam.common_subsequence(masks[k], len(items[k]), h[a:b].tolist()) for a, b, k in zip(lo, hi, item, strict=True)]
    assert got[0] == 64
    none = np.empty(0, np.int64)
    assert not len(decontam._common_lengths(h, none, none, none, none, decontam._held_bits(items[7:8]), decontam._masks_of_words(items[7:8])))


def test_word_hashes_are_polynomials():
    """Of ranges in any order, at any place: the sum of code * base^place in the word, and the length."""
    rng = np.random.default_rng(5)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    begin = rng.integers(0, 4900, 200)
    end = begin + rng.integers(1, 100, 200)
    base, mask = int(textarrays._WORD_BASE), (1 << 64) - 1
    want = [sum(int(textarrays.BYTE_CODE[x]) * pow(base, j, 1 << 64) for j, x in enumerate(data[a:b].tolist())) + int(b - a) & mask for a, b in zip(begin, end, strict=True)]
    assert textarrays.hash_words(data, begin, end).tolist() == mix64(np.array(want, np.uint64)).tolist()


def test_decontamination_in_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(decontam, "ITEM_BLOCK", 7)
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    items = [[word() for _ in range(25)] for _ in range(30)]
    docs = spark.createDataFrame([(i, " ".join([word() for _ in range(30)] + items[i] + items[(i + 1) % 30]), "t") for i in range(30)], "doc_id long, text string, items string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    assert len(list(decontam.read_items(bench))) > 2
    got = {r.doc_id: r["items"] for r in decontam.find_items(docs, bench).collect()}
    assert got == {i: sorted({i, (i + 1) % 30}) for i in range(30)}


def test_very_long_texts(spark):
    """A text of some megabytes in one row, by decontamination, line dedup and repeats."""
    rng = random.Random(4)
    long = [f"w{rng.randrange(10**5)}" for _ in range(300_000)]
    item = [f"item{i}" for i in range(30)]
    df = spark.createDataFrame([(1, " ".join(long[:150_000] + item + long[150_000:]), "s"), (2, " ".join(long[:100]), "t"), (3, "x" * 1_000_000, "u")], "doc_id long, text string, source string")
    bench = spark.createDataFrame([(5, " ".join(item))], "item_id long, text string")
    assert {r.doc_id: r["items"] for r in decontam.find_items(df, bench).collect()} == {1: [5], 2: [], 3: []}
    assert {r.doc_id: r.n_removed for r in linededup.remove_boilerplate(df).collect()} == {1: 0, 2: 0, 3: 0}
    short = len(" ".join(long[:100]))
    assert {r.doc_id: r.n_removed for r in suffix.remove_repeats(df).collect()} == {1: short, 2: short, 3: 1_000_000}


def test_repeats_query(spark):
    """The registered query at its own length of 400 bytes."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = QUERIES["op10_suffix_dedup"](spark, SF)
    assert got.columns[:5] == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted((tuple(r)[:5] for r in got.collect()), key=repr) == repeats_brute(rows, 400)
