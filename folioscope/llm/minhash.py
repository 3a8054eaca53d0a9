"""MinHash near-duplicates with sequential Bayesian verification.

A document's set is its distinct shingles of ``words`` words (lower-cased A-Z); equal
sets are one node, so copies cost one row each and no link. A node's signature has
``BANDS * ROWS`` minima; nodes that agree on a band share a bucket. With 40 bands of 6, two
sets of similarity 0.8 share none with probability (1 - 0.8**6)**40, about 5e-6.

Candidates are compared batch by batch of signature positions: with m of n equal and a
uniform prior, the posterior probability that the similarity reaches the threshold is
P(Bin(n + 1, t) <= m); a pair is dropped as soon as this is under ``MISS``. What is left
is verified on the full sets.

No bucket is ever expanded into all its pairs. In the first rounds its least node is
compared with the others, after which it has met everyone and leaves; buckets whose nodes
are of one component by then are done. Of the rest the nodes outside a bucket's largest
component are compared with all, inside the tasks that read them, ``BLOCK`` of them with
``BLOCK`` of all at a time, so that a large bucket is spread over tasks and one that is
nearly whole costs little: first by signatures alone, after which only nodes that survived
with some partner are sent on with their full sets, to be verified in the same groups; of
the links found only those leave a task that join two of its components. Buckets and
components of over ``HOT`` nodes meet what is known of them by a broadcast of these few
keys (their number is counted first), never in one task.

Edge cases: null, blank and empty texts have an empty set, link with nothing and are
their own component; a text of fewer than ``words`` words has its whole sequence as the
one shingle; a null id joins its component but never names it while another id can; rows
with equal ids are each a row of the result, and may be in different components where
their texts differ; an empty table gives no rows; a very long text is lexed in blocks and
costs eight bytes a shingle beside its own; other columns, whatever their names, aren't
read, and ``one_of_each`` passes them through.
"""

from __future__ import annotations

import math
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared
from .components import components
from .text import Lexer, Words, joined, mix, pieces

BANDS, ROWS = 40, 6
MISS = 1e-7
STEP = 40
BLOCK = 512
BLOCK_BYTES = 8 << 20
CELLS = 4 << 20
STAR_ROUNDS = 2
HOT = 1000
PAIRS = 250

_SEEDS = np.random.default_rng(7).integers(0, 1 << 32, (2, BANDS * ROWS), np.uint32) | np.uint32(1)


def shingles(words: Words, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    h, out = words.hashes, []
    all_ = joined(*(h[i : len(h) - k + 1 + i] for i in range(k))) if len(h) >= k else np.empty(0, np.uint64)
    for a, b in zip(words.docs[:-1], words.docs[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(all_[a : b - k + 1]))
        else:
            out.append(joined(*(h[i : i + 1] for i in range(a, b))) if b > a else np.empty(0, np.uint64))
    return out


def signature(own: np.ndarray) -> np.ndarray:
    """The minima of BANDS * ROWS hash functions over a set that isn't empty."""
    x, out = (own >> np.uint64(32)).astype(np.uint32), None
    for a in range(0, len(x), 2048):
        y = x[None, a : a + 2048] * _SEEDS[0][:, None]
        y ^= y >> np.uint32(15)
        y *= _SEEDS[1][:, None]
        low = y.min(axis=1)
        out = low if out is None else np.minimum(out, low)
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """The bucket of each signature in each band."""
    bands = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    key = mix(np.arange(1, BANDS + 1, dtype=np.uint64))[None, :]
    for r in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, r])
    return key


def node_of(own: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(own.tobytes())).astype(np.int64))


def least_equal(threshold: float, n: int, miss: float) -> int:
    """The fewest equal positions of n at which the posterior of similarity >= threshold isn't under ``miss``."""
    total = 0.0
    for m in range(n + 2):
        total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= miss:
            return m
    return n


class Pruning:
    """Sequential comparison of signatures, a batch of ``STEP`` positions at a time."""

    def __init__(self, percent: int):
        self.least = {n: least_equal(percent / 100, n, MISS) for n in range(STEP, BANDS * ROWS + 1, STEP)}

    def __call__(self, a: np.ndarray, b: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Which of the pairs (a[left], b[right]) survive."""
        alive, equal = np.arange(len(left)), np.zeros(len(left), np.int32)
        for n, least in self.least.items():
            if not len(alive):
                break
            cut = slice(n - STEP, n)
            equal = equal[: len(alive)] + (a[left[alive], cut] == b[right[alive], cut]).sum(axis=1, dtype=np.int32)
            keep = equal >= least
            alive, equal = alive[keep], equal[keep]
        return alive


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array([np.frombuffer(x.as_buffer(), np.uint16) for x in column]).reshape(len(column), -1)


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, at, node, n_shingles, sig, keys`` of every row; at is a hash of the text, and node, sig and keys are null for empty sets."""

    def run(batches):
        lexer = Lexer()
        for part in pieces(batches):
            sets = shingles(lexer(part.column("text")), words)
            full = [k for k, s in enumerate(sets) if len(s)]
            nodes, sigs, keys = [None] * len(sets), [None] * len(sets), [None] * len(sets)
            if full:
                signed = np.array([signature(sets[k]) for k in full])
                for k, sig, key in zip(full, signed.astype(np.uint16), band_keys(signed).view(np.int64), strict=True):
                    nodes[k], sigs[k], keys[k] = node_of(sets[k]), sig.tobytes(), key
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("at"), pa.array(nodes, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(sigs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "at", "node", "n_shingles", "sig", "keys"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("at")).mapInArrow(run, "doc_id long, at long, node long, n_shingles long, sig binary, keys array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame, words: int, repeated: bool) -> DataFrame:
    """``node, own``: the sorted shingle hashes of the wanted nodes (``node, id, id_at``), from the text of one such row each."""

    def run(batches):
        lexer = Lexer()
        for part in pieces(batches):
            for node, own in zip(part.column("node").to_pylist(), shingles(lexer(part.column("text")), words), strict=True):
                if node_of(own) == node:  # an id can name several texts
                    yield pa.RecordBatch.from_pydict({"node": [node], "own": pa.array([own.tobytes()], pa.binary())})

    def packed(batches):
        held, size = [], 0
        for b in run(batches):
            held.append(b)
            size += b.nbytes
            if size > 4 << 20:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("at"))
    texts = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("at") == F.col("id_at"))).select("node", "text")
    if repeated:  # of rows with equal id and text one is enough
        texts = texts.dropDuplicates(["node"])
    return texts.mapInArrow(packed, "node long, own binary")


def keyed(members: DataFrame, facts: DataFrame, name: str) -> DataFrame:
    """``members`` with the ``facts (key, n, ...)`` of their bucket; buckets without facts go.

    Buckets of over ``HOT`` members are few; they are joined without dealing members by key.
    """
    hot = shared.small(facts.filter(F.col("n") > HOT), name)
    cold = members.join(hot.select("key"), "key", "left_anti").join(facts.filter(F.col("n") <= HOT), "key")
    return members.join(hot, "key").unionByName(cold)


def pruned(pairs: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """The pairs (``u, v``) that Bayesian pruning leaves."""

    def run(batches):
        prune = Pruning(percent)
        for b in batches:
            if b.num_rows:
                each = np.arange(b.num_rows)
                yield b.select(["u", "v"]).take(pa.array(prune(_matrix(b.column("su")), _matrix(b.column("sv")), each, each)))

    sides = pairs.join(sigs.select(F.col("node").alias("v"), F.col("sig").alias("sv")), "v").join(sigs.select(F.col("node").alias("u"), F.col("sig").alias("su")), "u")
    return sides.select("u", "v", "su", "sv").mapInArrow(run, "u long, v long")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets reach the threshold. Each ``v`` is sent once per pair and each ``u`` once per about ``PAIRS`` of its pairs."""

    def run(batches):
        key, head = None, None
        for b in batches:
            found = []
            for u, salt, v, own in zip(*(b.column(c) for c in range(4)), strict=True):
                u, salt, v, own = u.as_py(), salt.as_py(), v.as_py(), np.frombuffer(own.as_buffer(), np.uint64)
                if v is None:
                    key, head = (u, salt), own
                elif key == (u, salt):
                    both = len(np.intersect1d(head, own, assume_unique=True))
                    if 100 * both >= percent * (len(head) + len(own) - both):
                        found.append((u, v))
            yield pa.RecordBatch.from_pydict({"u": pa.array([x for x, _ in found], pa.int64()), "v": pa.array([x for _, x in found], pa.int64())})

    many = shared.small(pairs.groupBy("u").agg(F.ceil(F.count("*") / PAIRS).alias("parts")).filter("parts > 1"), "near-heads")
    salt = F.coalesce(F.pmod(F.xxhash64("v"), F.col("parts")), F.lit(0)).cast("int")
    pairs = pairs.join(many, "u", "left").select("u", salt.alias("salt"), "v")
    pairs = shared.table(pairs, "near-pairs")
    heads = pairs.select("u", "salt").distinct().join(sets, F.col("u") == F.col("node")).select("u", "salt", F.lit(None).cast("long").alias("v"), "own")
    rest = pairs.join(sets, F.col("v") == F.col("node")).select("u", "salt", "v", "own")
    rows = heads.unionByName(rest).repartition("u", "salt").sortWithinPartitions("u", "salt", F.col("v").asc_nulls_first())
    return rows.mapInArrow(run, "u long, v long")


def linked(left: list[np.ndarray], right: list[np.ndarray], i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Which of the pairs (left[i], right[j]) of full sets reach the threshold, by products of incidence matrices."""
    rows, a = np.unique(i, return_inverse=True)
    cols, b = np.unique(j, return_inverse=True)
    known = np.unique(np.concatenate([left[k] for k in rows]))
    if len(rows) > 1 and len(rows) * len(known) > CELLS:  # few long sets at a time
        low = a < len(rows) // 2
        out = np.empty(len(i), bool)
        out[low], out[~low] = linked(left, right, i[low], j[low], percent), linked(left, right, i[~low], j[~low], percent)
        return out
    own = np.zeros((len(rows), len(known)), np.float32)
    for r, k in enumerate(rows):
        own[r, np.searchsorted(known, left[k])] = 1
    both, step = np.zeros((len(rows), len(cols)), np.int64), max(1, CELLS // len(known))
    for at in range(0, len(cols), step):
        some = cols[at : at + step]
        flat, row = np.concatenate([right[k] for k in some]), np.repeat(np.arange(len(some)), [len(right[k]) for k in some])
        place = np.minimum(np.searchsorted(known, flat), len(known) - 1)
        hit = known[place] == flat
        other = np.zeros((len(some), len(known)), np.float32)
        other[row[hit], place[hit]] = 1
        both[:, at : at + step] = np.rint(own @ other.T)
    both = both[a, b]
    sizes = np.array([len(left[k]) for k in rows])[a] + np.array([len(right[k]) for k in cols])[b]
    return 100 * both >= percent * (sizes - both)


class Forest:
    """Union-find over the places of a block: only links that join two trees are sent on."""

    def __init__(self, labels: np.ndarray):
        _, first, back = np.unique(labels, return_index=True, return_inverse=True)
        self.up = first[back].tolist()  # places of one component start in one tree

    def top(self, k: int) -> int:
        while self.up[k] != k:
            self.up[k] = self.up[self.up[k]]
            k = self.up[k]
        return k

    def join(self, a: int, b: int) -> bool:
        a, b = self.top(a), self.top(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


GROUPED = "key long, i int, j int, role int, node long, component long, sig binary"
#: Roles in a group: to be compared with all others; one of these, of the bucket's largest component or not.
LEFT, LARGEST, OTHER = 0, 1, 2


def _groups(batches, columns: int):
    """(key, i, j) and the rows of each group of a partition that is sorted by it."""
    held, now = [], None
    for b in batches:
        for key, some in groupby(zip(*(b.column(c).to_pylist() for c in range(columns)), strict=True), lambda r: r[:3]):
            if key != now:
                if len(held) > 1:
                    yield held
                held, now = [], key
            held.extend(some)
    if len(held) > 1:
        yield held


def _candidates(rows, prune: Pruning, tops):
    """Pairs of places in a group that survive pruning, some rows at a time; ``tops()``: the component of each place by now."""
    sig = np.array([np.frombuffer(r[6], np.uint16) for r in rows])
    role, node = (np.array([r[k] for r in rows]) for k in (3, 4))
    lefts, rights = np.flatnonzero(role == LEFT), np.flatnonzero(role != LEFT)
    for a in range(0, len(lefts), 64):
        top = tops()
        left, right = (x.ravel() for x in np.meshgrid(lefts[a : a + 64], rights, indexing="ij"))
        # two nodes that are both compared with all meet in two groups
        new = (top[left] != top[right]) & ((role[right] == LARGEST) | (node[left] < node[right]))
        left, right = left[new], right[new]
        alive = prune(sig, sig, left, right)
        if len(alive):
            yield left[alive], right[alive]


def blockwise(members: DataFrame, sigs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different components inside buckets (``key, node, component, size``): pruned, and verified on full sets.

    The nodes outside the largest component, in blocks, meet all nodes, in blocks, each
    pair of blocks in a group of its own of bounded bytes. A group sends on at most one
    link less than it has nodes: those that join its trees.
    """
    shares = members.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum(8 * F.col("size")).alias("bytes"))
    facts = shares.groupBy("key").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.max(F.struct("n", "component", "bytes")).alias("most"))
    blocks = lambda n, b: F.greatest(F.ceil(F.greatest(n / BLOCK, b / BLOCK_BYTES)), F.lit(1)).cast("int")
    facts = facts.select("key", "n", F.col("most.component").alias("largest"), blocks(F.col("n"), F.col("bytes")).alias("rights"), blocks(F.col("n") - F.col("most.n"), F.col("bytes") - F.col("most.bytes")).alias("lefts"))
    rows = keyed(members, shared.table(facts, "near-facts"), "near-hot").join(sigs, "node")
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    other, upto = F.col("component") != F.col("largest"), lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    slot = lambda i, j, role: F.struct(i.alias("i"), j.alias("j"), role.cast("int").alias("role"))
    all_ = F.transform(upto("lefts"), lambda i: slot(i, own("rights"), F.when(other, OTHER).otherwise(LARGEST)))
    lefts = F.transform(upto("rights"), lambda j: slot(own("lefts"), j, F.lit(LEFT)))
    rows = rows.select("key", F.explode(F.when(other, F.concat(all_, lefts)).otherwise(all_)).alias("slot"), "node", "component", "sig")
    rows = rows.select("key", "slot.i", "slot.j", "slot.role", "node", "component", "sig")

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def survivors(batches):
        prune = Pruning(percent)
        for rows in _groups(batches, 7):
            component, hit = np.array([r[5] for r in rows], np.int64), np.zeros(len(rows), bool)
            for left, right in _candidates(rows, prune, lambda component=component: component):
                hit[left] = hit[right] = True
            if hit.any():
                kept = [r for r, ok in zip(rows, hit, strict=True) if ok]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*kept, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=[x.split()[0] for x in GROUPED.split(", ")])

    def links(batches):
        prune = Pruning(percent)
        for rows in _groups(batches, 8):
            sets, node = [np.frombuffer(r[7], np.uint64) for r in rows], [r[4] for r in rows]
            trees, out = Forest(np.array([r[5] for r in rows], np.int64)), []
            for left, right in _candidates(rows, prune, lambda trees=trees, n=len(rows): np.array([trees.top(k) for k in range(n)])):
                good = linked(sets, sets, left, right, percent)
                out += [(node[x], node[y]) for x, y in zip(left[good].tolist(), right[good].tolist(), strict=True) if trees.join(x, y)]
            if out:
                yield pa.RecordBatch.from_pydict({"u": pa.array([x for x, _ in out], pa.int64()), "v": pa.array([y for _, y in out], pa.int64())})

    alive = shared.table(dealt(rows).mapInArrow(survivors, GROUPED), "near-survivors")
    return dealt(alive.join(sets, "node").select(*alive.columns, "own")).mapInArrow(links, "u long, v long")


def labelled(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """``doc_id, at, n_shingles, node, first`` of every row: first is the least ``doc_id, at`` of its component, ids that are null last; null for empty sets."""
    sketched = shared.table(sketches(docs, words), "near-sketches")
    nodes = sketched.filter("node is not null").groupBy("node").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "at")).alias("first"), F.first("n_shingles").alias("size"), F.first("sig").alias("sig"), F.first("keys").alias("keys")
    )
    nodes = shared.table(nodes, "near-nodes")
    rows = shared.table(sketched.select("doc_id", "at", "n_shingles", "node"), "near-rows")
    shared.drop(sketched)
    repeated = not rows.groupBy("doc_id", "at").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
    buckets = nodes.select("node", "size", F.explode("keys").alias("key"))
    # buckets of the same nodes are one: a pair in ten bands is met once
    code = F.xxhash64("node")
    shares = buckets.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(code).alias("x"), F.sum(F.shiftright(code, 20)).alias("s")).filter("n > 1")
    shares = shared.table(shares.groupBy("n", "x", "s").agg(F.min("key").alias("key")).select("key", "n"), "near-shares")
    buckets = shared.table(keyed(buckets, shares, "near-hot").select("key", "node", "size"), "near-buckets")
    wanted = buckets.select("node").distinct().join(nodes.select("node", F.col("first.doc_id").alias("id"), F.col("first.at").alias("id_at")), "node")
    sets = shared.table(full_sets(docs, wanted, words, repeated), "near-sets")
    sigs = nodes.select("node", "sig")
    links, parts = None, None
    for turn in range(STAR_ROUNDS + 1):
        members = buckets if parts is None else buckets.join(parts, "node", "left")
        members = members.withColumn("component", F.coalesce("component", "node") if parts is not None else F.col("node"))
        members = shared.table(members, "near-members")
        spread = members.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("head"), F.min("component").alias("low"), F.max("component").alias("high"), F.min_by("component", "node").alias("of"))
        spread = shared.table(spread.filter("low <> high").drop("low", "high"), "near-spread")
        members = shared.table(keyed(members, spread, "near-hot"), "near-open")
        if turn < STAR_ROUNDS:
            pairs = members.filter("node <> head and component <> of").select(F.col("head").alias("u"), F.col("node").alias("v")).distinct()
            found = verified(shared.table(pruned(pairs, sigs, percent), "near-candidates"), sets, percent)
            buckets = members.filter("node <> head").select("key", "node", "size")
        else:
            found = blockwise(members.select("key", "node", "component", "size"), sigs, sets, percent).distinct()
        found = shared.table(found, "near-links")
        links = found if links is None else links.unionByName(found)
        parts = shared.table(components(links), "near-components")
    labels = nodes.select("node", "first").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    labels = shared.table(labels.withColumnRenamed("component", "key"), "near-parts")
    names = shared.table(labels.groupBy("key").agg(F.count("*").alias("n"), F.min("first").alias("first")), "near-names")
    labels = shared.table(keyed(labels.drop("first"), names, "near-hot").select("node", "first"), "near-labels")
    shared.drop(nodes, sets)
    return rows.join(labels, "node", "left")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row."""
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id"))
    return labelled(docs, words, percent).select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row of ``docs``, all columns, of each component: of the least id, or none if all are null, and then of the least hash of the text.

    Of rows of an empty set, each a component, those with equal id and text are one.
    """
    first = F.col("node").isNull() | (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("at") == F.col("first.at")))
    kept = shared.table(labelled(docs, words, percent).filter(first).select(F.struct("doc_id", "at").alias("kept")), "near-kept")
    once = kept.groupBy("kept").agg(F.count("*").alias("n"))
    repeated = not once.filter("n > 1").isEmpty()
    work = shared.fresh(docs, "near")
    rows = docs.withColumn(work, F.struct("doc_id", F.xxhash64("text").alias("at")))
    theirs = shared.fresh(rows, "near")
    mine = (once if repeated else kept).select(F.col("kept").alias(theirs))
    rows = rows.join(mine, F.col(work).eqNullSafe(F.col(theirs)), "left_semi")
    if repeated:  # of rows with equal id and text any one
        rows = rows.withColumn(work, F.to_json(work, {"ignoreNullFields": "false"})).dropDuplicates([work])
    return rows.select(*docs.columns)


def op1_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=2)


OP1_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END)) AS s FROM w),
sets AS (SELECT s, min(doc_id) AS node, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s),
items AS (SELECT node, n, unnest(s) AS x FROM sets),
pairs AS (SELECT a.node AS u, b.node AS v FROM items a JOIN items b ON a.x = b.x AND a.node < b.node
  AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
edges AS (SELECT u, v FROM pairs UNION SELECT v, u FROM pairs),
reach AS (SELECT node AS a, node AS b FROM sets UNION SELECT r.a, e.v FROM reach r JOIN edges e ON r.b = e.u),
lab AS (SELECT a AS node, min(b) AS component_id FROM reach GROUP BY a),
named AS (SELECT s, component_id FROM sets JOIN lab USING (node))
SELECT d.doc_id, len(d.s)::BIGINT AS n_shingles, coalesce(l.component_id, d.doc_id) AS component_id, d.doc_id = coalesce(l.component_id, d.doc_id) AS kept
FROM s d LEFT JOIN named l ON d.s = l.s
"""
