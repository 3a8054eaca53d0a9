"""Source divergence, substring removal and vector codes against plain Python, and their results on odd rows."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioscope.llm import divergence, substrings, text, vector_codes

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, term string, anchor int, at int, n int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank and long texts, repeated rows, clashing columns."""
    long = "the cat sat on the mat " * 4000
    texts = [(1, "A b a b", "en", "s"), (2, None, None, None), (3, "", "en", "s"), (4, " \n\t", "fr", "s"), (5, long, "en", None), (5, long, "en", None), (6, long, None, "z"), (None, long, "fr", "z"), (7, "12 34 Ünï-x", "fr", "s")]
    return spark.createDataFrame([(*t, "x", 1, 2, 3) for t in texts], SCHEMA)


def brute_divergence(rows, least, top):
    """rows: (lang, source, text)."""
    counts, df, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, body in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        own = Counter(TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), body or "")))
        counts[lang, source].update(own)
        df[lang].update(own.keys())
    out = []
    for lang, sources in groups.items():
        terms = [t for t, n in df[lang].items() if n >= least]

        def shares(own):
            under = sum(own[t] for t in terms) + 2 * len(terms)
            return {t: 1 + 1_000_000_000 * (own[t] + 2) // under for t in terms}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in terms)) for o in sources if o != s]
            best = [(t, f(p[s][t], q[t])) for t in terms if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", best)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(items) if part == "pair" or k < top]
    return sorted(out)


def found(df):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in df.collect())


@pytest.mark.parametrize("least, top", [(10, 10), (2, 3)])
def test_divergence_is_that_of_plain_counts(docs, least, top):
    rows = [(r.lang, r.source, r.text) for r in docs.collect()]
    assert found(divergence.divergence(docs, least, top)) == brute_divergence(rows, least, top)


def test_divergence_in_small_pieces(docs, monkeypatch):
    """Memos that are emptied, sums that are sent on early and runs over many batches change nothing."""
    plain = found(divergence.divergence(docs, 2, 10))
    sums = divergence.Sums()
    rng, total = np.random.default_rng(1), Counter()
    monkeypatch.setattr(divergence, "HELD", 50)
    for _ in range(40):
        keys, n = rng.integers(0, 90, 30), rng.integers(1, 9, 30)
        sums.add(keys, n)
        for k, v in zip(keys.tolist(), n.tolist(), strict=True):
            total[k] += v
    keys, n = sums.pop()
    assert dict(zip(keys.tolist(), n.tolist(), strict=True)) == total and sums.pop() is None
    counts = divergence.counted(docs.repartition(3)).groupBy("lang", "term", "source").agg(F.sum("df").alias("df"), F.sum("n").alias("n"))
    assert counts.filter("term is null").count() == docs.select("lang", "source").distinct().count()
    assert found(divergence.divergence(docs.repartition(5), 2, 10)) == plain


def test_runs_go_on_over_batches():
    rows = [("a", "x")] * 3 + [("a", "y")] + [("b", None)] * 2 + [("b", "y")] * 4
    table = pa.table({"lang": [r[0] for r in rows], "term": pa.array([r[1] for r in rows], pa.string())})
    for size in (1, 2, 3, 20):
        runs = [[tuple(r.values()) for r in t.to_pylist()][a:b] for t, first in divergence._runs(table.to_batches(size)) for a, b in zip(first, [*first[1:], t.num_rows], strict=True)]
        assert runs == [[("a", "x")] * 3, [("a", "y")], [("b", None)] * 2, [("b", "y")] * 4]


def test_divergence_pairs_of_many_sources_in_blocks(spark):
    assert sorted(zip(*(np.concatenate(x).tolist() for x in zip(*divergence._pairs(1030), strict=True)), strict=True)) == [(i, j) for i in range(1030) for j in range(i + 1, 1030)]
    rows = [("en", f"s{i % 70:02}", f"shared word w{i % 9} {'x' * (i % 5 + 1)}") for i in range(700)]
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    assert found(divergence.divergence(df)) == brute_divergence(rows, 10, 10)


def test_divergence_of_odd_rows(spark, odd):
    rows = [(r.lang, r.source, r.text) for r in odd.collect()]
    assert found(divergence.divergence(odd, 1)) == brute_divergence(rows, 1, 10)
    none = divergence.divergence(odd)  # no term is in ten documents
    assert {(r.part, r.value) for r in none.collect()} == {("pair", 0)}
    assert divergence.divergence(odd.limit(0)).count() == 0


def brute_repeats(rows, window):
    """rows: (doc_id, text), in order; what op12 returns for each."""
    words = [WORD.findall(t or "") for _, t in rows]
    low = {}
    for (i, _), w in zip(rows, words, strict=True):
        for a in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[a : a + window])
                low[key] = min(low.get(key, i), i)
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for a in range(len(w) - window + 1):
            if i is not None and low[tuple(w[a : a + window])] < i:
                gone[a : a + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def removed(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()), key=str)


@pytest.mark.parametrize("window, gram", [(50, 20), (12, 5), (6, 6), (3, 1)])
def test_repeats_are_those_of_all_windows(docs, window, gram):
    some = docs.filter("n_chars < 6000") if window < 50 else docs
    rows = [(r.doc_id, r.text) for r in some.collect()]
    expected = brute_repeats(rows, window)
    assert sum(r[2] for r in expected)
    assert removed(substrings.repeats(some, window, gram)) == expected


def test_repeats_among_variants_of_shared_passages(spark):
    """Passages in new surroundings, cut short, with changed words, repeated inside a text, and of one word only."""
    rng = np.random.default_rng(5)
    passages = [[f"p{k}w{i}" for i in range(int(rng.integers(8, 90)))] for k in range(6)] + [["same"] * 60, ["a", "b"] * 30]
    rows = []
    for d in range(160):
        words = []
        for _ in range(rng.integers(1, 5)):
            own = list(passages[rng.integers(len(passages))])
            if rng.random() < 0.4:
                own = own[rng.integers(0, 5) : len(own) - rng.integers(0, 5)]
            if own and rng.random() < 0.4:
                own[rng.integers(len(own))] = f"x{rng.integers(3)}"
            words += own + [f"n{rng.integers(40)}" for _ in range(rng.integers(0, 12))]
        rows.append((int(d // 2 if d % 10 == 1 else d) if d % 17 else None, "  ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for window, gram in ((12, 5), (20, 8)):
        assert removed(substrings.repeats(df, window, gram)) == brute_repeats(rows, window)


def test_segments_cover_each_window_once(monkeypatch):
    rng = np.random.default_rng(2)
    hashes = text.mix(rng.integers(0, 5, 3000).astype(np.uint64))
    plain = substrings.Segments(hashes, 12, 5)
    assert [*np.concatenate([np.arange(b, b + n) for b, n in zip(plain.begin, plain.length, strict=True)])] == [*range(3000 - 11)]
    every = {}
    for k in range(len(plain.begin)):
        for at, h in zip(range(plain.begin[k], plain.begin[k] + plain.length[k]), plain.windows(k).tolist(), strict=True):
            assert every.setdefault(hashes[at : at + 12].tobytes(), (int(plain.anchor[k]), h)) == (int(plain.anchor[k]), h)
    monkeypatch.setattr(substrings, "SPAN", 100)
    for k, own in enumerate(pieces := [substrings.Segments(hashes, 12, 5)]):
        assert sum(own.length) == 3000 - 11 and len(own.begin) >= len(plain.begin) and pieces[k] is own
        assert {(int(a), int(h)) for s in range(len(own.begin)) for a, h in ((own.anchor[s], x) for x in own.windows(s))} == set(every.values())
    assert len(substrings.Segments(hashes[:11], 12, 5).begin) == 0


def test_repeats_of_odd_rows(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert removed(substrings.repeats(odd)) == brute_repeats(rows, 50)
    assert substrings.repeats(odd.limit(0)).count() == 0


def test_repeats_of_a_text_beyond_a_block(spark):
    rng = np.random.default_rng(3)
    long = " ".join(f"w{i}" for i in rng.integers(0, 50_000, 400_000).tolist())
    rows = [(2, long), (1, long[700_000:1_500_000]), (3, "é" * (text.BLOCK + 7) + " " + long[:90_000])]
    assert removed(substrings.repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == brute_repeats(rows, 50)


def brute_codes(rows, parts=4, entries=256, rounds=4):
    """rows: (vec_id, label, vector) in order of id; codes, errors and codebooks by comparison with all entries."""
    inside = lambda x: max(-vector_codes.MOST - 1, min(vector_codes.MOST, x))
    kept = [(i, label, [inside(math.floor(1024 * x)) for x in v]) for i, label, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][2]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, _, v in kept[:entries]] for p in range(parts)]

    def near(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        own = [defaultdict(list) for _ in range(parts)]
        for _, _, v in kept:
            for p in range(parts):
                own[p][near(v, p)[1]].append(cut(v, p))
        books = [[[sum(c) // len(own[p][k]) for c in zip(*own[p][k], strict=True)] if own[p][k] else e for k, e in enumerate(books[p])] for p in range(parts)]
    out = []
    for i, label, v in kept:
        best = [near(v, p) for p in range(parts)]
        out.append((i, label, [k for _, k in best], min(sum(d for d, _ in best), vector_codes.MOST)))
    return out, books


def codes(df, **more):
    rows, books = vector_codes.coded(df, **more)
    return sorted(((r.vec_id, r.label, r.code, r.error) for r in rows.collect()), key=str), [b.tolist() for b in books.books]


VECTORS = "vec_id long, label int, embedding array<float>, code string, error string, v int"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 0) for r in rows], VECTORS)


@pytest.mark.parametrize("entries", [5, 40])
def test_codes_are_those_of_all_entries(spark, entries):
    rng = np.random.default_rng(4)
    rows = [(i, int(rng.integers(3)) or None, np.round(rng.normal(0, 1, 8), 1).tolist()) for i in range(300)]  # many ties
    expected, books = brute_codes(rows, entries=entries)
    assert codes(vectors(spark, rows), entries=entries) == (sorted(expected, key=str), books)


def test_query_of_codes_is_its_plain_form(spark):
    rows = [(r.vec_id, r.label, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()]
    expected, books = brute_codes(rows)
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    total = Counter()
    for _, label, _, error in expected:
        total[label] += error
    got = vector_codes.op13_vector_codes(spark, SF).collect()
    assert {r.vec_id: (r.code, r.error, r.label_error, r.codebooks_sha256) for r in got} == {i: (bytes(c).hex(), e, total[label], sha) for i, label, c, e in expected}


@pytest.mark.parametrize("kind", [np.float64, object])
def test_tree_finds_the_least_of_the_nearest(kind):
    rng = np.random.default_rng(6)
    scale = 1 if kind is np.float64 else 1 << 40
    for width, spread in ((1, 30), (3, 4), (6, 1000)):
        entries = (rng.integers(-spread, spread, (256, width)) * scale).astype(kind)
        rows = (rng.integers(-spread, spread, (500, width)) * scale).astype(kind)
        tree = vector_codes.Tree(entries)
        at, best = tree.nearest(rows)
        every = vector_codes.distances(rows, entries)
        assert at.tolist() == [int(np.argmin(d)) for d in every] and best.tolist() == [min(d) for d in every.tolist()]
        if width < 6:
            assert tree.met < every.size / 2  # most entries are skipped


def test_codes_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, 1, [0.5, -0.25, 1.0, 2.0]), (1, None, [0.5, -0.25, 1.0, 2.0]), (2, 1, [3e38, -3e38, 0.0, 1e-30]), (3, None, [1e5, -1e6, 7e7, 0.1])]
    bad = [(0, 1, None), (4, 1, [nan, 0.0, 0.0, 0.0]), (5, 1, [inf, 0.0, 0.0, 0.0]), (6, 1, [None, 0.0, 0.0, 0.0]), (7, 1, []), (8, 1, [1.0]), (9, 2, [0.0] * 8), (-1, 2, [1.0, 2.0])]
    df = vectors(spark, [*good, (None, 3, [0.0, 0.0, 0.0, 0.0]), *bad])
    most = vector_codes.MOST
    order = sorted(((i, label, [float(np.float32(x)) for x in v]) for i, label, v in good), key=lambda r: (r[0], r[2])) + [(None, 3, [0.0] * 4)]
    for entries, rounds in ((2, 4), (9, 0), (3, 1)):
        expected, books = brute_codes(order, entries=entries, rounds=rounds)
        assert codes(df, entries=entries, rounds=rounds) == (sorted(expected, key=str), books)
    rows, books = vector_codes.coded(df, entries=1, rounds=0)
    assert [b.shape for b in books.books] == [(1, 1)] * 4
    got = {(r.vec_id, r.label): (r.code, r.error) for r in rows.collect()}
    assert max(e for _, e in got.values()) == most
    errors = vector_codes.with_label_error(rows)
    assert {(r.vec_id, r.label): r.label_error for r in errors.collect()}[1, None] == min(most, got[1, None][1] + got[3, None][1])
    assert vector_codes.coded(df.limit(0))[0].count() == 0 and vector_codes.coded(vectors(spark, bad[:4]))[0].count() == 0
