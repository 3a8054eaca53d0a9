"""What the search of decontamination reads and holds, and spans of several passes."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from folioscope.llm import decontaminate


def words(rng, n, of):
    return [f"w{x}" for x in rng.integers(0, of, n)]


def test_shifts_skip_most_places():
    rng = np.random.default_rng(1)
    items = [(str(k), " ".join(words(rng, 20, 4000))) for k in range(50)]
    matcher = decontaminate.Matcher(items)
    (engine,) = matcher.engines
    unknown = " ".join(f"x{k}" for k in range(60_000))
    assert next(matcher(pa.array([unknown])))[1:] == ([], [])
    lanes = 60_000 / decontaminate.LANE
    assert engine.read <= 60_000 / 13 + 2 * lanes  # all thirteen words of a window are skipped
    engine.read = 0
    known = " ".join(words(rng, 60_000, 4000))
    assert next(matcher(pa.array([known + " " + items[7][1]])))[1:] == ([(60_000, 60_020)], ["7"])
    assert engine.read <= 60_000 / 6


def test_equal_items_and_very_many_occurrences():
    items = [("b", "one"), ("a", "one"), ("c", "two words here"), ("a", "other"), ("d", "")]
    matcher = decontaminate.Matcher(items)
    text = "one x " * 400_000 + "two words here"
    tracemalloc.start()
    counts, row, begin, end, of, item = matcher.find(pa.array(["x", text, None, "one two words here one"]))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert counts.tolist() == [1, 800_003, 0, 5] and np.bincount(row, minlength=4).tolist() == [0, 400_001, 0, 1]
    assert (end - begin).tolist() == [1] * 400_000 + [3, 5]
    assert list(zip(of.tolist(), matcher.ids[item].tolist())) == [(r, i) for r in (1, 3) for i in ("a", "b", "c")]
    assert most < 200 << 20


def test_spans_of_passes_are_united(spark):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(200):
        spans = [(int(a), int(a + rng.integers(1, 6))) for a in rng.integers(0, 40, rng.integers(0, 12))]
        rows.append((k, [{"start": a, "end": b} for a, b in spans]))
    df = spark.createDataFrame([*rows, (-1, None)], "k int, spans array<struct<start:int,end:int>>").repartition(3)
    got = {r.k: [(x.start, x.end) for x in r.s] for r in df.select("k", decontaminate.united(F.col("spans")).alias("s")).collect()}
    for k, spans in rows:
        hit = sorted({p for x in spans for p in range(x["start"], x["end"])})
        assert [p for a, b in got[k] for p in range(a, b)] == hit
        assert all(b < c for (_, b), (c, _) in zip(got[k], got[k][1:]))
    assert got[-1] == []
