"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard similarity.

Shingles are five words (``tokens.words``); a text of fewer words has one shingle of all of them. The weight of a shingle is its count in
the text times ln((N + 1) / (df + 1)) + 1, with N all documents and df an estimate of the documents with the shingle: the median of
``DF_ROWS`` counts under independent hashes, each less what the other shingles of its bucket bring on average. The ``2**DF_BITS``
buckets a row don't grow with the corpus (3 MB); an estimate is off by some sqrt(shingles of all documents / buckets) documents, so what
is told apart are shingles in more documents than that, and all rarer ones weigh alike. ``BANDS`` bands of ``ROWS`` samples find pairs of weighted
Jaccard similarity 0.8 with probability 0.9998; every candidate is verified on the whole texts and linked at ``SIMILAR`` or more.

The shingles that a large group of copies shares lose weight as the group grows, and those that one copy alone has don't, so that near copies within it
fall below ``SIMILAR`` by weights though nearly all their words agree. With ``plain``, as the query asks, texts are also linked whose shingles by counts
alone have a Jaccard similarity of ``SIMILAR``; ``PLAIN_BANDS`` more bands of unweighted samples find such pairs with probability 0.98 at 0.8 besides
those that the weighted bands find.

Texts with the same words are one class before anything is compared, so copies never meet as pairs. Classes in a bucket are
held against one hub first; only pairs still apart that can be similar follow, so a large group of near copies costs little more
than its size.

Texts without words (null, empty, punctuation only) link with nothing. Rows with a null doc_id link with nothing, have no
component and are kept. Rows with the same doc_id are documents of their own that share the id. The smallest doc_id of a component
names it; ties don't arise. Long texts are read whole. An empty table gives an empty table. Other columns pass through ``drop_near``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pefloom.llm import tokens
from pefloom.llm.common import connected_components, cut, with_root

SIMILAR = 0.8
BANDS, ROWS = 16, 4
PLAIN_BANDS = 8
DF_BITS, DF_ROWS = 18, 3
#: Multipliers of the rows' hashes, odd. Fixed values.
DF_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
#: Up to so many ids of documents to be compared are sent to all tasks (8 bytes each); more are joined by a shuffle.
SEND_IDS = 2_000_000


def _draws() -> tuple[np.ndarray, np.ndarray]:
    """The 2**16 quantiles of Gamma(2, 1), and their logs: a hash's 16 bits pick one."""
    u = (np.arange(1 << 16) + 0.5) / (1 << 16)
    x = np.linspace(1e-6, 40, 1 << 20)
    gamma = np.interp(u, 1 - np.exp(-x) * (1 + x), x)
    return gamma.astype(np.float32), np.log(gamma).astype(np.float32)


def counted(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, count) of the distinct shingles of each row, their offsets by row, and two hashes of each row's words."""
    h, _, _, woffs = tokens.words(data, offs)
    hashes, row = tokens.shingles(h, woffs)
    n = len(offs) - 1
    order = np.lexsort((hashes, row)) if len(hashes) else np.zeros(0, np.int64)
    hashes, row = hashes[order], row[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(hashes)))
    soffs = np.searchsorted(row[at], np.arange(n + 1))
    whole = np.zeros((2, n), np.uint64)
    place = (np.arange(len(h)) - np.repeat(woffs[:-1], np.diff(woffs))).astype(np.uint64)
    full = np.flatnonzero(np.diff(woffs))
    for k in range(2):
        if len(full):
            whole[k, full] = np.add.reduceat(tokens.mix(h + tokens.mix(place + np.uint64(k << 40))), woffs[full])
    return hashes[at], count, soffs, whole[0].view(np.int64), whole[1].view(np.int64)


def buckets(shingle: np.ndarray, row: int, bits: int) -> np.ndarray:
    """The bucket of each shingle in one row of the document counts."""
    return ((shingle * np.uint64(DF_ODD[row])) >> np.uint64(64 - bits)).astype(np.int64)


def idf_table(docs: DataFrame, bits: int = DF_BITS) -> np.ndarray:
    """The inverse document frequency that each bucket of each row of counts over all documents tells."""
    size = 1 << bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros((DF_ROWS, size), np.int64), 0
        for b in batches:
            n += b.num_rows
            for _, _, data, offs in tokens.slices(b.column("text")):
                shingle = counted(data, offs)[0]
                for r in range(DF_ROWS):
                    df[r] += np.bincount(buckets(shingle, r, bits), minlength=size)
        at = np.flatnonzero(df)
        yield pa.record_batch([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(df.ravel()[at], n))], ["bucket", "n"])

    got = docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    at, n = got["bucket"].to_numpy(), got["n"].to_numpy()
    df = np.zeros(DF_ROWS * size)
    df[at[at >= 0]] = n[at >= 0]
    df, docs_ = df.reshape(DF_ROWS, size), n[at < 0].sum()
    df = df - (df.sum(1, keepdims=True) - df) / (size - 1)
    return (np.log((docs_ + 1) / (np.clip(df, 1, max(docs_, 1)) + 1)) + 1).astype(np.float32)


def idf_of(idf: np.ndarray, shingle: np.ndarray) -> np.ndarray:
    """The middle one of the three rows' values."""
    bits = idf.shape[1].bit_length() - 1
    x, y, z = (idf[r][buckets(shingle, r, bits)] for r in range(DF_ROWS))
    return np.maximum(np.minimum(x, y), np.minimum(np.maximum(x, y), z))


def signatures(shingle: np.ndarray, weight: np.ndarray, soffs: np.ndarray, draws: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Band hashes (rows with shingles, BANDS) by consistent weighted sampling of each row's weighted shingles."""
    gamma, log_gamma = draws
    lens = np.diff(soffs)
    starts = soffs[:-1][lens > 0]
    lens = lens[lens > 0]
    log_w = np.log(weight).astype(np.float32)
    out = np.zeros((BANDS, len(starts)), np.uint64)
    for k in range(BANDS * ROWS):
        h = (shingle ^ np.uint64((k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xD1B54A32D192ED03)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x81DADEF4BC2DD44D)
        r = gamma[(h >> np.uint64(48)).astype(np.int64)]
        beta = ((h >> np.uint64(16)).astype(np.uint32) >> np.uint32(16)).astype(np.float32) * np.float32(2.0**-16)
        t = np.floor(log_w / r + beta)
        log_a = log_gamma[((h >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.int64)] - r * (t - beta + np.float32(1))
        least = np.minimum.reduceat(log_a, starts)
        at = np.flatnonzero(log_a == np.repeat(least, lens))
        at = at[np.searchsorted(at, starts)]
        picked = tokens.mix(shingle[at] + tokens.mix(t[at].astype(np.int64).view(np.uint64)))
        out[k // ROWS] = tokens.mix(out[k // ROWS] * np.uint64(31) + picked)
    return out.T


def plain_signatures(shingle: np.ndarray, soffs: np.ndarray) -> np.ndarray:
    """Band hashes (rows with shingles, PLAIN_BANDS) by the least hashes of each row's distinct shingles."""
    starts = soffs[:-1][np.diff(soffs) > 0]
    out = np.zeros((PLAIN_BANDS, len(starts)), np.uint64)
    for k in range(PLAIN_BANDS * ROWS):
        h = (shingle ^ np.uint64((k + 1) * 0xC2B2AE3D27D4EB4F & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xD1B54A32D192ED03)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x81DADEF4BC2DD44D)
        out[k // ROWS] = tokens.mix(out[k // ROWS] * np.uint64(31) + np.minimum.reduceat(h, starts))
    return out.T


def sketches(docs: DataFrame, idf: np.ndarray, plain: bool = False) -> DataFrame:
    """(doc_id, t, h1, h2, bands) of the documents with an id and words; h1 and h2 stand for the sequence of words, t for the text."""
    held = docs.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draws = _draws()
        for b in batches:
            for first, _, data, offs in tokens.slices(b.column("text")):
                shingle, count, soffs, h1, h2 = counted(data, offs)
                rows = np.flatnonzero(np.diff(soffs))
                if len(rows):
                    bands = signatures(shingle, count * idf_of(held.value, shingle), soffs, draws)
                    bands = np.concatenate([bands, plain_signatures(shingle, soffs)], 1) if plain else bands
                    flat = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * bands.shape[1], pa.int32()), pa.array(bands.ravel().view(np.int64)))
                    at = pa.array(first + rows)
                    yield pa.record_batch([b.column("doc_id").take(at), b.column("t").take(at), pa.array(h1[rows]), pa.array(h2[rows]), flat], ["doc_id", "t", "h1", "h2", "bands"])

    rows = docs.where("doc_id IS NOT NULL AND text <> ''").select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("t"))
    return rows.mapInArrow(run, "doc_id long, t long, h1 long, h2 long, bands array<long>")


def _unpacked(x: bytes, idf: np.ndarray, plain: bool) -> tuple[np.ndarray, np.ndarray]:
    """(sorted shingles, weights) of a packed row: shingles, then their counts; with ``plain`` the counts are a second row of weights."""
    n = len(x) // 12
    shingle, count = np.frombuffer(x, np.uint64, n), np.frombuffer(x, np.int32, n, 8 * n).astype(float)
    weight = count * idf_of(idf, shingle).astype(float)
    return shingle, np.stack([weight, count] if plain else [weight])


def overlap(idf: np.ndarray, a: bytes, b: bytes, plain: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of two packed rows: the weight they share, the weight of each, the shingles of b of which a has less, and their largest weight; all but the
    shingles by kind of weight."""
    (x, wx), (y, wy) = _unpacked(a, idf, plain), _unpacked(b, idf, plain)
    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
    mine = np.where(x[at] == y, wx[:, at], 0.0)
    more = mine[-1] < wy[-1]
    return np.minimum(mine, wy).sum(1), wx.sum(1), wy.sum(1), y[more], wy[:, more].max(1, initial=0.0)


def weighted_jaccard(idf: np.ndarray, a: bytes, b: bytes) -> float:
    both, wa, wb, *_ = overlap(idf, a, b)
    return float((both / (wa + wb - both))[0])


#: A bucket of so many classes or fewer is compared pair by pair.
SMALL = 8


def near_components(docs: DataFrame, similar: float = SIMILAR, plain: bool = False) -> DataFrame:
    """(doc_id, t, h1, root) of the documents with an id and words, t standing for the text; root stands for the document's component.
    Texts are similar by weights or, with ``plain``, by counts.

    Every class has a hub, the class that shares most buckets with most others among those it meets; in a group of near copies that is
    nearly the original, and one pair a class links most of them. A pair u, v still apart that has the hub p in common can only be
    similar if shared(u, v) >= s / (1 + s) * (weight(u) + weight(v)), and shared(u, v) <= shared(u, p) + what both have beyond p. Pairs
    that pass this test by one kind of weight, that have different hubs or that lie in small buckets are verified, each in the first bucket it shares,
    so no link between components is lost.
    """
    docs = docs.select("doc_id", "text")
    idf = idf_table(docs)
    held = docs.sparkSession.sparkContext.broadcast(idf)
    sketched = cut(sketches(docs, idf, plain))
    classes = sketched.groupBy("h1").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"))
    members = classes.select(F.posexplode("bands").alias("k", "band"), F.col("h1").alias("id")).select(F.xxhash64("k", "band").alias("bucket"), "k", "id")
    own = Window.partitionBy("bucket")
    shared = cut(members.withColumn("n", F.count("*").over(own)).where("n > 1"))
    known = shared.join(shared.groupBy("id").agg(F.sum("n").alias("fame")), "id")
    star = known.withColumn("centre", F.max(F.struct("fame", "id")).over(own))
    hubs = star.groupBy("id").agg(F.max("centre").alias("hub"), (F.max("n") > SMALL).alias("big")).select("id", F.col("hub.id").alias("hub"), "big")
    star = cut(star.select("bucket", "k", "id", "n", F.col("centre.id").alias("centre")))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            want = b.column("h1").to_numpy()
            for first, end, data, offs in tokens.slices(b.column("text")):
                shingle, count, soffs, h1, _ = counted(data, offs)
                rows = [k for k in range(end - first) if h1[k] == want[first + k]]
                packed = [shingle[soffs[k] : soffs[k + 1]].tobytes() + count[soffs[k] : soffs[k + 1]].astype(np.int32).tobytes() for k in rows]
                yield pa.record_batch([pa.array(h1[rows], pa.int64()), pa.array(packed, pa.binary())], ["h1", "packed"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x, y, big in zip(b.column(3), b.column(4), b.column(2).to_pylist(), strict=True):
                both, wa, wb, beyond, top = overlap(held.value, x.as_py(), y.as_py(), plain)
                out.append((bool((both >= similar * (wa + wb - both)).any()), both, wb, top, beyond.view(np.int64) if big else np.zeros(0, np.int64)))
            cols = [pa.array([o[k] for o in out], t) for k, t in enumerate((pa.bool_(), *[pa.list_(pa.float64())] * 3, pa.list_(pa.int64())))]
            yield pa.record_batch([*b.columns[:2], *cols], ["a", "b", "like", "both", "weight", "top", "beyond"])

    def compared(pairs: DataFrame) -> DataFrame:
        """(a, b, like, both, weight, top, beyond) of the pairs (a, b, big): whether they are similar, what they share, b's weight and what it
        has beyond a, with the largest weight there; weights by kind."""
        pairs = cut(pairs)
        ids = pairs.select(F.col("a").alias("h1")).union(pairs.select("b")).distinct()
        ids = cut(ids.join(classes.select("h1", "doc_id"), "h1"))
        texts = docs.join(F.broadcast(ids) if ids.count() <= SEND_IDS else ids, "doc_id").select("h1", "text")
        texts = texts.mapInArrow(pack, "h1 long, packed binary").groupBy("h1").agg(F.first("packed").alias("packed"))
        both = pairs.join(texts.select(F.col("h1").alias("b"), F.col("packed").alias("y")), "b").join(texts.select(F.col("h1").alias("a"), F.col("packed").alias("x")), "a")
        return cut(both.select("a", "b", "big", "x", "y").mapInArrow(compare, "a long, b long, like boolean, both array<double>, weight array<double>, top array<double>, beyond array<long>"))

    first = compared(hubs.select(F.col("hub").alias("a"), F.col("id").alias("b"), "big"))  # a hub also meets itself
    edges = first.where("like").select("a", "b")
    roots = connected_components(edges)
    home = F.max(F.when(F.col("id") == F.col("centre"), F.col("root"))).over(own)
    open_ = with_root(star, roots).withColumns({"home": home, "lo": F.min("root").over(own), "hi": F.max("root").over(own)}).where("lo < hi").select("bucket", "k", "id", "n", "root", "home")
    told = first.select(F.col("b").alias("id"), F.col("a").alias("hub"), "both", "weight", "top", "beyond").join(classes.select(F.col("h1").alias("id"), "bands"), "id")
    rows = cut(open_.join(told, "id"))
    pack_ = lambda p: F.struct("id", "root", "home", "k", "n", "hub", "both", "weight", "top", "beyond", "bands").alias(p)
    new = "a.root <> b.root AND (b.root = a.home OR a.id < b.id) AND a.id <> b.hub AND b.id <> a.hub"
    once = "array_position(zip_with(a.bands, b.bands, (x, y) -> x = y), true) = a.k + 1"
    can = " OR ".join(f"least(a.both[{i}] + n * a.top[{i}], b.both[{i}] + n * b.top[{i}]) * {(1 + similar) / similar * (1 + 1e-9)} >= a.weight[{i}] + b.weight[{i}]" for i in range(1 + plain))
    can = f"exists(array(size(array_intersect(a.beyond, b.beyond))), n -> {can})"
    # one of a pair in different components isn't in the centre's
    left, right = rows.where("root <> home").select("bucket", pack_("a")), rows.select("bucket", pack_("b"))
    met = left.join(right, (left["bucket"] == right["bucket"]) & F.expr(f"{new} AND (a.n <= {SMALL} OR a.hub <> b.hub OR {can}) AND {once}"))
    rest = met.select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b"), F.lit(False).alias("big")).distinct()
    more = compared(rest).where("like").select("a", "b")
    roots = roots if more.isEmpty() else connected_components(edges.union(more))
    return sketched.select("doc_id", "t", "h1").join(roots.withColumnRenamed("id", "h1"), "h1", "left").select("doc_id", "t", "h1", F.coalesce("root", "h1").alias("root"))


def components(docs: DataFrame, similar: float = SIMILAR, plain: bool = False) -> DataFrame:
    """(doc_id, component_id, kept) of every document; kept marks the smallest doc_id of its component."""
    found = cut(near_components(docs, similar, plain))
    named = found.join(found.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    out = docs.select("doc_id").join(named, "doc_id", "left")
    return out.select("doc_id", F.coalesce("component_id", F.col("doc_id").cast("long")).alias("component_id")).withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))


def drop_near(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """``docs`` without the documents of a component other than its smallest by (doc_id, hash of the text); rows that repeat it stay.

    Of two texts with one doc_id each is judged by itself.
    """
    found = cut(near_components(docs, similar))
    keep = found.groupBy("root").agg(F.min(F.struct("doc_id", "t")).alias("keep"))
    gone = found.join(keep, "root").where(F.struct("doc_id", "t") != F.col("keep")).select(F.col("doc_id").alias("id_"), F.col("t").alias("t_")).distinct()
    return docs.join(gone, (docs["doc_id"].cast("long") == gone["id_"]) & (F.xxhash64(docs["text"]) == gone["t_"]), "left_anti")


def op9_neardup(docs: DataFrame, plain: bool = False) -> DataFrame:
    """(doc_id, component_id, kept) of every document."""
    return components(docs, plain=plain)
