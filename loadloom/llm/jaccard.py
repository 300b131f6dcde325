"""N-gram Jaccard join with a token-group matrix: exact, on whole texts.

A document's set holds the 64-bit hashes of its distinct word shingles.  Sets of equal 128-bit digests are one class.  Classes are
compared by the prefix principle: in any one order of all tokens, two sets of similarity t or more share a token
among the first n - ceil(t n) + 1 of each.  The order here has tokens that hash low first, of these those
listed by at most ``FREQUENT`` classes first, then by hash; so boilerplate that many documents share hardly ever is a candidate's
only evidence.  Then

1.  in rounds, each class is checked against a hub, of a few classes chosen by hash the one with which it shares most
    prefix tokens; verified links give first components;
2.  classes with boilerplate in their prefix get a second one, by an order of their own in which all tokens frequent among
    them come last: whatever links only by boilerplate is a pair of these;
3.  by either order, classes are partitioned into slices of at most about ``GROUP`` members of a component.  The
    token-group matrix holds the union of the prefix tokens of a group; a class queries the groups of larger components that share
    a rarer token with it: the overlap with a group's union bounds that with any member, and only groups whose bound reaches
    the overlap that the threshold needs are opened;
4.  classes of little but boilerplate, which still have it in their second prefix, are grouped by its most frequent token, in slices of
    bounded size.  Groups that share a token are opened in pairs, their members' whole sets multiplied as matrices;
5.  the links complete the components.

Classes already in one component need no further check, so a group of n near copies costs n checks and not n^2, and no
link between different components is lost.

Scale: rows between tasks are tokens of prefixes (about a third of all shingles; all of classes with boilerplate in their
prefix), counts of them, and sets of classes with a checked pair.  Counts are pre-aggregated; tokens of a third of all documents are met in sort-merge
joins, which Spark splits.  Broadcast: rows of classes, if at most ``BROADCAST_BYTES`` as hashed; beyond that they are joined.

Edge cases: null and empty texts, or texts of white space, have an empty set and are linked with nothing; a text of fewer
words than a shingle is one shingle; repeated rows and ties share a component; null ids take part, but name
no component; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, discard, let_go, materialise, pieces, table
from .components import components

CUTOFF, FREQUENT, GROUP, WHOLE = 0.30, 32, 32, 32
#: Rounds of first checks, which end when one adds less than a part in ENOUGH of the links.
ROUNDS, ENOUGH = 4, 10
#: Of a group that is opened as a whole.
GROUP_TOKENS, GROUP_CLASSES, SIZES = 131_072, 512, 0.15
BROADCAST_BYTES, ROW_BYTES, TOLD = 64 << 20, 64, 500_000
CACHED = 150_000
ROUND_BYTES = 256 << 20
#: Shuffled for a token of a document; rounds read the lists again, so there are only a few.
TOKEN_BYTES, TOKEN_ROUNDS = 28, 4
MIX = np.uint64(0x9E3779B97F4A7C15)
LOW = int(CUTOFF * 2**64) - 2**63


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 48:
            if len(self) >= CACHED:
                self.clear()
            self[word] = h
        return h


_words = _Words()


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: Sequence[bytes | None], width: int) -> list[np.ndarray]:
    """Sorted distinct hashes, as signed integers, of each text in UTF-8."""
    lists = [(t or b"").lower().split() for t in texts]
    lengths = [len(x) for x in lists]
    w = np.fromiter(map(_words.__getitem__, chain.from_iterable(lists)), np.uint64, sum(lengths))
    rolled = w.copy()
    for _ in range(width - 1):
        # The value at i covers the words from i on; windows over a text's end are cut off below.
        rolled[:-1] = rolled[1:]
        rolled *= MIX
        rolled += w
    rolled = _stir(rolled).view(np.int64)
    out, at = [], 0
    for n in lengths:
        if n >= width:
            h = np.sort(rolled[at : at + n - width + 1])
            out.append(h[np.concatenate(([True], h[1:] != h[:-1]))])
        elif n:
            short = np.full(1, n, np.uint64)
            for i in range(at, at + n):
                short = _stir(short * MIX + w[i : i + 1])
            out.append(short.view(np.int64))
        else:
            out.append(np.empty(0, np.int64))
        at += n
    return out


def shingles(text: bytes | None, width: int) -> np.ndarray:
    return shingle_sets([text], width)[0]


def _digest(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def prefix_length(n, t: int):
    """Of t hundredths."""
    return n - (t * n + 99) // 100 + 1


def _sketched(docs: DataFrame, t: int, width: int) -> DataFrame:
    """``_id``, ``_digest`` (of the set, null if empty), ``_n``, ``_low`` (tokens that hash low) and ``_tokens``: those, the prefix by hash at least;
    and the columns of ``docs`` after its second."""
    extra = docs.schema.fields[2:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 1, 256):
                rows = shingle_sets(batch.column(1).to_pylist(), width)
                low = [int(np.searchsorted(s, LOW)) for s in rows]
                kept = [s[: max(k, prefix_length(len(s), t)) if len(s) > WHOLE else len(s)] for s, k in zip(rows, low, strict=True)]
                ends = np.concatenate(([0], np.cumsum([len(s) for s in kept]))).astype(np.int32)
                tokens = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(kept) if kept else np.empty(0, np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(map(_digest, rows), pa.binary()), pa.array([len(s) for s in rows], pa.int64()), pa.array(low, pa.int64()), tokens, *batch.columns[2:]],
                    names=["_id", "_digest", "_n", "_low", "_tokens", *names],
                )
        _words.clear()

    names = [f.name for f in extra]
    return arrow_map(docs, run, ", ".join(["_id long, _digest binary, _n long, _low long, _tokens array<long>", *(f"{f.name} {f.dataType.simpleString()}" for f in extra)]))


def _sets(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 1, 256):
                rows = shingle_sets(batch.column(1).to_pylist(), width)
                yield pa.RecordBatch.from_arrays([pa.array(map(_digest, rows), pa.binary()), pa.array([s.tobytes() for s in rows], pa.binary())], names=["_digest", "_set"])
        _words.clear()

    return arrow_map(docs, run, "_digest binary, _set binary")


def _checked(df: DataFrame, n: int | None = None) -> DataFrame:
    """Broadcast if the rows, of a few numbers each, are few enough."""
    return F.broadcast(df) if (df.count() if n is None else n) * ROW_BYTES <= BROADCAST_BYTES else df


def _fits(a: Column, b: Column, t: int) -> Column:
    return 100 * F.least(a, b) >= t * F.greatest(a, b)


def _needed(a: Column, b: Column, t: int) -> Column:
    return F.ceil(t * (a + b) / (100.0 + t))


def _class_sets(keys: DataFrame, n: int, classes: DataFrame, docs: DataFrame, width: int, used: list[DataFrame]) -> DataFrame:
    """``_key`` and ``_set`` of the ``n`` rows of ``keys``, made again from the text of the class's first document; what is written for it is added to ``used``."""
    met = materialise(classes.join(_checked(keys.select("_key"), n), "_key", "left_semi").select("_key", "_digest", "_first"), "ids")
    used.append(met)
    several = met.count()
    ids = met.select(F.col("_first").alias("_id"))
    chosen = docs.join(_checked(ids, several), docs["_id"].eqNullSafe(ids["_id"]), "left_semi")
    sets = _sets(chosen, width).where(F.col("_digest").isNotNull())
    return sets.groupBy("_digest").agg(F.first("_set").alias("_set")).join(_checked(met.select("_key", "_digest"), several), "_digest").select("_key", "_set")


PACK = "_g struct<_anchor: long, _slice: long>, _keys binary, _roots binary, _sizes binary, _tokens binary, _rows binary"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each group's members, and the union of their tokens, sorted, with the members that have them."""
    for batch in batches:
        out: list[list[bytes]] = [[] for _ in range(5)]
        for members in batch.column(1):
            inner = members.values
            sets = [np.frombuffer(q.as_buffer(), np.int64) for q in inner.field("_set")]
            sizes = inner.field("_n").to_numpy()
            tokens, rows = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.int32), [len(q) for q in sets])
            order = np.argsort(tokens, kind="stable")
            for column, x in zip(out, (inner.field("_key").to_numpy(), inner.field("_root").to_numpy(), sizes, tokens[order], rows[order]), strict=True):
                column.append(x.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.binary()) for x in out)], names=["_g", "_keys", "_roots", "_sizes", "_tokens", "_rows"])


def _as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column's lists of tokens as bytes."""
    for batch in batches:
        lists = batch.column(4)
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([x.values.to_numpy().tobytes() for x in lists], pa.binary())], names=["_g", "_key", "_root", "_n", "_set"])


def _group_links(left, right, t: int, prefixes: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A spanning set of the links between members of two groups that are of different components; with ``prefixes``, where the
    groups have only tokens of their members' prefixes, the members on either side that may be linked."""
    (ka, ra, na, ta, ia), (kb, rb, nb, tb, ib) = left, right
    hit = np.minimum(np.searchsorted(tb, ta), len(tb) - 1)
    sa = tb[hit] == ta
    hit = np.minimum(np.searchsorted(ta, tb), len(ta) - 1)
    sb = ta[hit] == tb
    # The overlap with a group's union bounds that with its members.
    qa, qb = np.bincount(ia[sa], minlength=len(ka)), np.bincount(ib[sb], minlength=len(kb))
    qa, qb = (qa > 0, qb > 0) if prefixes else (100 * qa >= t * na, 100 * qb >= t * nb)
    if not qa.any() or not qb.any():
        return ka[:0], kb[:0]
    sa &= qa[ia]
    sb &= qb[ib]
    (fa, ua), (fb, ub) = np.unique(ia[sa], return_inverse=True), np.unique(ib[sb], return_inverse=True)
    vocabulary = np.intersect1d(ta[sa], tb[sb])
    pa_, pb = np.searchsorted(vocabulary, ta[sa]), np.searchsorted(vocabulary, tb[sb])
    shared = np.zeros((len(fa), len(fb)), np.float32)
    for at in range(0, len(vocabulary), 8192):
        m, n = np.zeros((len(fa), 8192), np.float32), np.zeros((len(fb), 8192), np.float32)
        for x, rows, places, tokens in ((m, ua, pa_, ta[sa]), (n, ub, pb, tb[sb])):
            use = (places >= at) & (places < min(at + 8192, len(vocabulary)))
            use[use] = vocabulary[places[use]] == tokens[use]
            x[rows[use], places[use] - at] = 1
        shared += m @ n.T
    xa, xb = na[fa][:, None], nb[fb][None, :]
    if prefixes:  # all other tokens that can be shared lie beyond the prefix of one of the two
        shared = shared + np.maximum(-(-t * xa // 100), -(-t * xb // 100)) - 1
    good = (100 * shared >= t * (xa + xb - shared)) & (100 * np.minimum(xa, xb) >= t * np.maximum(xa, xb)) & (ra[fa][:, None] != rb[fb][None, :])
    i, j = np.flatnonzero(good.any(1)), np.flatnonzero(good.any(0))
    good = good[np.ix_(i, j)]
    if not good.size:
        return ka[:0], kb[:0]
    if prefixes:
        return ka[fa[i]], kb[fb[j]]
    # Labels pass to and fro until each holds the least of its component.
    la = np.arange(len(i))
    while True:
        lb = np.where(good, la[:, None], len(i)).min(0)
        new = np.minimum(la, np.where(good, lb[None, :], len(i)).min(1))
        if (new == la).all():
            break
        la = new
    first = ka[fa[i]]
    u = np.concatenate([first, kb[fb[j]]])
    v = np.concatenate([first[la], first[lb]])
    return u[u != v], v[u != v]


def _may_link(t: int):
    """The pairs of groups for which some pair of members may be linked, with those members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[int] = set()  # members that this task has named lately
        for batch in batches:
            found = [np.concatenate(_group_links(*_sides(batch, k, 2), t, prefixes=True)).tolist() for k in range(batch.num_rows)]
            kept = pa.array([len(x) > 0 for x in found], pa.bool_())
            new = []
            for x in filter(None, found):
                new.append([y for y in x if y not in told])
                told.update(x)
                if len(told) > TOLD:
                    told.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept), pa.array(new, pa.list_(pa.int64()))], names=["_g", "_h", "_keys"])

    return run


def _sides(batch: pa.RecordBatch, k: int, first: int) -> list[list[np.ndarray]]:
    kinds = (np.int64,) * 4 + (np.int32,)
    return [[np.frombuffer(batch.column(first + 5 * side + c)[k].as_buffer(), kinds[c]) for c in range(5)] for side in (0, 1)]


def _open(t: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = [], []
            for k in range(batch.num_rows):
                a, b = _group_links(*_sides(batch, k, 2), t)
                u.append(a)
                v.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], names=["u", "v"])

    return run


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, t: int, width: int) -> DataFrame:
    """Of ``a``, ``b`` those whose sets are similar: ``u``, ``v``, written.  Sets are made again from the texts of the classes met; as
    they are large, their shuffle files go before anything else is done."""
    pairs = materialise(pairs.select("a", "b"), "pairs")
    if not (n := pairs.count()):
        return pairs.toDF("u", "v")
    used = [pairs]
    sets = _class_sets(pairs.select(F.col("a").alias("_key")).union(pairs.select("b")), 2 * n, classes, docs, width, used)
    left = sets.select(F.col("_key").alias("a"), F.col("_set").alias("_left"))
    right = sets.select(F.col("_key").alias("b"), F.col("_set").alias("_right"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "_left", "_right")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            similar = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.int64), np.frombuffer(y.as_buffer(), np.int64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                similar.append(100 * shared >= t * (len(x) + len(y) - shared))
            kept = pa.array(similar, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept)], names=["u", "v"])

    links = materialise(arrow_map(both, check, "u long, v long"), "links")
    discard(*used)
    return links


def _prefixes(lists: DataFrame, sized: DataFrame, t: int, low: Column) -> DataFrame:
    """``_token``, ``_key``, ``_n`` and ``_df``: the tokens of each prefix that another class lists too, with the classes that list them, written.

    ``lists``, which are deleted: _key, _tokens; ``sized``: _key, _n, _low (how many tokens are ``low``: of those, the frequent ones come last)."""
    tokens: list[DataFrame] = []
    listed = lists.select("_key", F.posexplode("_tokens").alias("_rank", "_token"))
    # All tokens are sent twice, which takes more of the disk than anything else: they are dealt into rounds, each of which has its shuffle
    # files deleted before the next.
    sent = (lists.agg(F.sum(F.size("_tokens"))).first()[0] or 0) * TOKEN_BYTES
    rounds, shared = max(1, min(TOKEN_ROUNDS, -(-sent // ROUND_BYTES))), None
    for turn in range(rounds):
        some = listed.where(F.pmod("_token", F.lit(rounds)) == turn)
        counts = some.groupBy("_token").agg(F.count("*").alias("_df")).where(F.col("_df") > 1)
        met = materialise(some.join(counts, "_token").select("_token", "_key", "_rank", "_df"), "tokens")
        shared = met if shared is None else shared.unionByName(met)
        tokens.append(met)
        let_go(met)
    discard(lists)

    of_class = Window.partitionBy("_key")
    before = of_class.orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)
    often = ((F.col("_df") > FREQUENT) & low).cast("int")
    placed = shared.join(sized, "_key").withColumn("_off", often)
    placed = placed.withColumn("_earlier", F.coalesce(F.sum("_off").over(before), F.lit(0))).withColumn("_all", F.sum("_off").over(of_class))
    place = F.when(~low, F.col("_rank")).when(F.col("_off") == 1, F.col("_low") - F.col("_all") + F.col("_earlier")).otherwise(F.col("_rank") - F.col("_earlier"))
    prefix = materialise(placed.where(place < F.expr(f"_n - ({t} * _n + 99) div 100 + 1")).select("_token", "_key", "_n", "_df"), "prefix")
    discard(*tokens)
    return prefix


def _left(prefix: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of prefixes, which are deleted, the tokens of several components, with the root; and the number of frequent tokens of each class.  Both written."""
    rooted = _rooted(prefix, roots)
    several = rooted.groupBy("_token").agg(F.min("_root").alias("_r0"), F.max("_root").alias("_r1")).where(F.col("_r0") != F.col("_r1"))
    often = prefix.groupBy("_key").agg(F.sum((F.col("_df") > FREQUENT).cast("int")).alias("_usual"))
    rooted = materialise(rooted.join(several, "_token", "left_semi"), "rooted")
    often = materialise(often, "usual")
    discard(prefix)
    return rooted, often


def _asked(rooted: DataFrame, often: DataFrame, roots: DataFrame, t: int, used: list[DataFrame]) -> DataFrame:
    """``a``, ``b``: classes that share a rarer token with a group of another component, and its members; what is written for it is added to ``used``."""
    sizes = roots.groupBy("root").agg((F.count("*") + 1).alias("_size"))
    rare = rooted.where(F.col("_df") <= FREQUENT).join(sizes, F.col("_root") == F.col("root"), "left").drop("root")
    rare = rare.withColumn("_size", F.coalesce("_size", F.lit(1))).withColumn("_slice", F.pmod(F.xxhash64("_key"), F.ceil(F.col("_size") / GROUP)))
    cells = materialise(rare.select("_token", "_key", "_n", "_root", "_slice", F.struct("_size", "_root").alias("_order")), "cells")
    used.append(cells)
    several = cells.groupBy("_token").agg(F.min("_order").alias("_least"), F.max("_order").alias("_most")).where(F.col("_least") != F.col("_most"))
    asking = cells.join(several, "_token").where(F.col("_order") != F.col("_most")).select("_token", "_key", "_n", "_order")
    matrix = cells.join(several, "_token", "left_semi").groupBy("_token", "_root", "_slice").agg(F.first("_order").alias("_of"))
    met = asking.join(matrix, "_token").where(F.col("_of") > F.col("_order")).groupBy("_key", "_n", "_root", "_slice").agg(F.count("*").alias("_c"))
    groups = cells.groupBy("_root", "_slice").agg(F.min("_n").alias("_n0"), F.max("_n").alias("_n1"))
    met = met.join(groups, ["_root", "_slice"]).join(often, "_key").withColumn("_rest", F.expr(f"({t} * _n + 99) div 100 - 1"))
    top = F.greatest("_rest", F.expr(f"({t} * _n1 + 99) div 100 - 1"))
    opened = met.where((100 * F.col("_n1") >= t * F.col("_n")) & (t * F.col("_n0") <= 100 * F.col("_n")))
    opened = opened.where(F.col("_c") + F.col("_usual") + top >= _needed(F.col("_n"), F.greatest("_n0", F.ceil(t * F.col("_n") / 100.0)), t))
    members = cells.select("_root", "_slice", F.col("_key").alias("_member"), F.col("_n").alias("_m")).distinct()
    return opened.join(members, ["_root", "_slice"]).where(_fits(F.col("_n"), F.col("_m"), t)).select(F.col("_key").alias("a"), F.col("_member").alias("b"))


def _as_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole sets as lists of tokens."""
    for batch in batches:
        sets = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(1)]
        ends = np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64)))], names=["_key", "_tokens"])


def _rooted(prefix: DataFrame, roots: DataFrame) -> DataFrame:
    return prefix.join(_checked(roots), prefix["_key"] == roots["u"], "left").select("_token", "_key", "_n", "_df", F.coalesce("root", "_key").alias("_root"))


def _boilerplate(prefix: DataFrame, roots: DataFrame, classes: DataFrame, docs: DataFrame, t: int, width: int) -> DataFrame:
    """``u``, ``v``: links without a rarer token in common, written; ``prefix``: the frequent tokens of prefixes.

    Classes are grouped by the most frequent token of their prefix and by size; pairs of groups are opened as wholes, for the members
    whose overlap with the other group allows a link."""
    usual = _rooted(prefix, roots)
    several = usual.groupBy("_token").agg(F.min("_root").alias("_r0"), F.max("_root").alias("_r1")).where(F.col("_r0") != F.col("_r1"))
    usual = materialise(usual.join(several, "_token", "left_semi"), "boilerplate")
    if usual.isEmpty():
        discard(usual)
        return roots.select("u", F.col("root").alias("v")).limit(0)
    anchored = usual.groupBy("_key").agg(F.first("_n").alias("_n"), F.first("_root").alias("_root"), F.max(F.struct("_df", "_token"))["_token"].alias("_token"))
    anchored = anchored.withColumn("_sized", F.floor(F.ln("_n") / SIZES))
    amounts = anchored.groupBy("_sized").agg(F.greatest(F.ceil(F.sum("_n") / GROUP_TOKENS), F.ceil(F.count("*") / GROUP_CLASSES)).alias("_parts"))
    anchored = anchored.join(F.broadcast(amounts), "_sized")  # as many rows as there are magnitudes of sizes
    anchored = anchored.select("_key", "_n", "_root", "_sized", F.xxhash64("_sized", F.pmod(F.xxhash64("_token"), F.col("_parts"))).alias("_anchor"))
    slices = anchored.groupBy("_anchor").agg(F.greatest(F.ceil(F.sum("_n") / GROUP_TOKENS), F.ceil(F.count("*") / GROUP_CLASSES)).alias("_slices"))
    anchored = anchored.join(slices, "_anchor").withColumn("_slice", F.pmod(F.xxhash64("_key"), F.col("_slices"))).drop("_slices")
    anchored = materialise(anchored, "anchored")
    placed = usual.select("_token", "_key").join(anchored, "_key").withColumn("_g", F.struct("_anchor", "_slice"))
    spans = placed.groupBy("_token", "_g", "_sized").agg(F.min("_n").alias("_n0"), F.max("_n").alias("_n1"))
    whole = anchored.groupBy(F.struct("_anchor", "_slice").alias("_h")).agg(F.min("_root").alias("_r0"), F.max("_root").alias("_r1"), F.min("_n").alias("_n0"), F.max("_n").alias("_n1"))
    # Groups that share a token and may differ so much in size; then each class's overlap with the group.
    sizes_fit = lambda n0, n1, m0, m1: (100 * F.col(n1) >= t * F.col(m0)) & (100 * F.col(m1) >= t * F.col(n0))
    mine = placed.groupBy("_g", "_token", "_sized").agg(F.min("_n").alias("_m0"), F.max("_n").alias("_m1"))
    # Members of a group are of one band of sizes; those of larger ones meet only where a similar size can be.
    apart = int(np.ceil(np.log(100 / t) / SIZES))
    mine = mine.withColumn("_band", F.explode(F.sequence(F.col("_sized"), F.col("_sized") + apart)))
    pairs = mine.join(spans.withColumnsRenamed({"_g": "_h", "_sized": "_band"}), ["_token", "_band"]).where(sizes_fit("_m0", "_m1", "_n0", "_n1") & ((F.col("_band") > F.col("_sized")) | (F.col("_g") <= F.col("_h"))))
    pairs = pairs.groupBy("_g", "_h").agg(F.count("*").alias("_tokens")).join(whole, "_h")
    sized = anchored.groupBy(F.struct("_anchor", "_slice").alias("_g")).agg(F.min("_n").alias("_m0"), F.max("_n").alias("_m1"), F.min("_root").alias("_s0"), F.max("_root").alias("_s1"))
    pairs = pairs.join(sized, "_g").where(F.least("_r0", "_s0") != F.greatest("_r1", "_s1"))
    least = F.greatest(F.col("_n0"), F.ceil(t * F.col("_m0") / 100.0))
    longest = F.greatest(F.expr(f"({t} * _m1 + 99) div 100 - 1"), F.expr(f"({t} * _n1 + 99) div 100 - 1"))
    pairs = pairs.where(F.col("_tokens") + longest >= _needed(F.col("_m0"), least, t))
    pairs = materialise(pairs.select("_g", "_h"), "met")

    def paired(pairs: DataFrame, members: DataFrame, run, schema: str, label: str) -> DataFrame:
        """What ``run`` makes of pairs with what both groups hold, written; ``members``: _g, _key, _root, _n, _set.

        A group is sent once for each pair that it is in, which grows faster than the groups do: pairs are dealt into rounds, each
        of which sends twice the groups' size, or ``ROUND_BYTES``, and has its shuffle files deleted before the next."""
        packs = materialise(arrow_map(members.groupBy("_g").agg(F.collect_list(F.struct("_key", "_root", "_n", "_set")).alias("_members")), _pack, PACK), "packs")
        parts = [c for c in packs.columns if c != "_g"]
        held = packs.select("_g", sum(F.octet_length(c) for c in parts).cast("long").alias("_bytes"))
        whole = held.agg(F.sum("_bytes")).first()[0] or 0
        sent = pairs.join(held, "_g").agg(F.sum("_bytes")).first()[0] or 0
        rounds = max(1, -(-sent // max(ROUND_BYTES, 2 * whole)))
        out = None
        for turn in range(rounds):
            some = pairs.where(F.pmod(F.xxhash64("_g", "_h"), F.lit(rounds)) == turn)
            both = some.join(packs, "_g").select("_g", "_h", *[F.col(c).alias(f"left{c}") for c in parts])
            both = both.join(packs.select(F.col("_g").alias("_h"), *parts), "_h").select("_g", "_h", *[f"left{c}" for c in parts], *parts)
            made = materialise(arrow_map(both, run, schema), label)
            out = made if out is None else out.unionByName(made)
            if turn == rounds - 1:
                discard(packs, *free)
                free.clear()
            else:
                let_go(packs)
        return out

    # The union of a group's tokens of boilerplate first, its members' whole sets where that allows a link.
    tokens = placed.groupBy("_g", "_key", "_root", "_n").agg(F.collect_list("_token").alias("_set"))
    free = [pairs]
    tokens = arrow_map(tokens, _as_bytes, "_g struct<_anchor: long, _slice: long>, _key long, _root long, _n long, _set binary")
    pairs = paired(pairs, tokens, _may_link(t), "_g struct<_anchor: long, _slice: long>, _h struct<_anchor: long, _slice: long>, _keys array<long>", "opened")
    able = pairs.select(F.explode("_keys").alias("_key")).distinct()
    inside = anchored.withColumn("_g", F.struct("_anchor", "_slice")).join(able, "_key", "left_semi").select("_g", "_key", "_root", "_n")
    inside = materialise(inside, "inside")
    free.append(inside)
    sets = _class_sets(inside, inside.count(), classes, docs, width, free)
    links = paired(pairs.select("_g", "_h"), inside.join(sets, "_key"), _open(t), "u long, v long", "links")
    discard(usual, anchored)
    return links


def linked_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", t: int = 75, width: int = 5, extra: Sequence[str] = (), root_col: str | None = None) -> DataFrame:
    """``id_col``, ``n_shingles`` and ``component_id``, one row for each of ``df``; t in hundredths.

    Its columns ``extra`` are carried along.  ``root_col`` names a column for the component's key, which tells components
    apart where ids are null or repeat; it is null for texts without shingles."""
    docs = df.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("binary").alias("_text"), *extra)
    sketches = materialise(_sketched(docs, t, width).withColumn("_row", F.monotonically_increasing_id()), "sketches")
    docs = docs.select("_id", "_text")
    # A class goes by the number of its first row: that of the smallest id.
    first = F.min(F.struct(F.col("_id").isNull().alias("_none"), "_id", "_row"))
    classes = sketches.where(F.col("_digest").isNotNull()).groupBy("_digest").agg(first.alias("_f"), F.first("_n").alias("_n"), F.first("_low").alias("_low"))
    classes = materialise(classes.select("_digest", F.col("_f._row").alias("_key"), F.col("_f._id").alias("_first"), "_n", "_low"), "classes")

    # The lists of each class once: those of its first row.
    firsts = classes.select(F.col("_key").alias("_row"))
    lists = materialise(sketches.join(_checked(firsts), "_row", "left_semi").select(F.col("_row").alias("_key"), "_tokens"), "lists")
    named = materialise(sketches.select("_id", "_digest", "_n", *extra), "named")
    discard(sketches)
    prefix = _prefixes(lists, classes.select("_key", "_n", "_low"), t, F.col("_token") < LOW)

    # First components: rounds of checks of each class against a hub, the first by a hash of the round's own of those that
    # share a token with it; after the first round only over tokens of boilerplate.  They only save work below; what they
    # leave out is found there.
    links, roots, found, live = None, None, 0, prefix.withColumn("_root", F.col("_key"))
    for turn in range(ROUNDS):
        if turn:
            live = _rooted((live if turn > 1 else live.where(F.col("_df") > FREQUENT)).drop("_root"), roots)
        order = F.struct(F.xxhash64("_key", F.lit(turn)).alias("h"), F.col("_key").alias("hub"), F.col("_root").alias("root"))
        hubs = live.groupBy("_token").agg(F.min(order).alias("_hub"), F.min("_root").alias("_r0"), F.max("_root").alias("_r1")).where(F.col("_r0") != F.col("_r1"))
        spokes = live.join(hubs.select("_token", "_hub"), "_token").where(F.col("_hub.root") != F.col("_root"))
        spokes = spokes.groupBy("_key", "_n", F.col("_hub.hub").alias("_to")).agg(F.count("*").alias("_c")).where(F.col("_c") * 2 >= F.expr(f"_n - ({t} * _n + 99) div 100 + 1"))
        best = spokes.groupBy("_key").agg(F.max(F.struct("_c", "_to")).alias("_b")).select(F.col("_b._to").alias("a"), F.col("_key").alias("b"))
        more = _verified(best, classes, docs, t, width)
        links = more if links is None else links.unionByName(more)
        roots = components(links)
        new, found = more.count(), found + more.count()
        if turn and new * ENOUGH <= found:
            break

    # What is left: tokens of several components.  A link without a rarer token in common is one of two classes with boilerplate in their
    # prefix.  They are compared by an order of their own, in which all their tokens that are frequent among them come last, so that only
    # classes of little but boilerplate keep it in their prefix.
    rooted, often = _left(prefix, roots)
    used = [rooted, often]
    asked = _asked(rooted, often, roots, t, used)
    plain = materialise(rooted.where(F.col("_df") > FREQUENT).select("_key", "_n").distinct(), "again")
    used.append(plain)
    usual = None
    if several := plain.count():
        sets: list[DataFrame] = []
        whole = _class_sets(plain, several, classes, docs, width, sets)
        lists = materialise(arrow_map(whole, _as_lists, "_key long, _tokens array<long>"), "lists")
        discard(*sets)
        again, often = _left(_prefixes(lists, plain.withColumn("_low", F.col("_n")), t, F.lit(True)), roots)
        used.append(often)
        asked = asked.union(_asked(again, often, roots, t, used)).distinct()
        usual = again.where(F.col("_df") > FREQUENT).select("_token", "_key", "_n", "_df")
    links = links.unionByName(_verified(asked, classes, docs, t, width))
    discard(*used)
    if usual is not None:
        roots = components(links)
        links = links.unionByName(_boilerplate(usual, roots, classes, docs, t, width))
        discard(again)

    roots = components(links)
    naming = classes.join(roots, classes["_key"] == roots["u"], "left").select("_digest", F.coalesce("root", "_key").alias("_root"), "_first")
    names = naming.groupBy("_root").agg(F.min("_first").alias("_name"))
    out = named.join(naming.join(names, "_root").select("_digest", "_name", "_root"), "_digest", "left")
    more = [*extra, *([F.col("_root").alias(root_col)] if root_col else [])]
    return out.select(F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), F.coalesce("_name", "_id").alias("component_id"), *more)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_components(table(spark, sf_dir, "documents"))
