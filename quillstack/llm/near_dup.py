"""Near-duplicate classes by DartMinHash.

Exact copies (equal lower-cased word sequences) fold into one text first.  Each
remaining text throws hashed darts at the areas of its five-word shingles: weight,
the number of times a shingle occurs, along one axis, rank along the other, cut
into fixed dyadic cells so that equal shingles of any two texts meet the same
darts.  A dart that lands
under its shingle's weight and under the text's rank limit belongs to the text;
every coordinate keeps its earliest dart.  Runs of ``ROWS`` coordinates make
``BANDS`` band keys.  Texts sharing a band key are compared by their whole
weighted shingle sets: a link is a weighted Jaccard similarity of ``SIMILARITY``
or more, shingles being told apart by 48 bits of their hash.

No bucket is expanded into all its pairs.  Inside a bucket every text is first
compared with one centre, twice with different centres; texts that are then in
one component need no further comparison.  In a bucket of more than ``DIRECT``
texts a text can only link to another component if it has enough shingles that
occur in another component at all; texts with fewer leave the bucket, and what
stays is compared with a third centre, the text with most such shingles.  Only
pairs of texts still in different components are compared directly: in buckets
of up to ``DIRECT`` texts as pairs, each in its first common bucket, in larger
buckets block against block inside a task, which gives out only links that join
components.  The largest component of a bucket is never compared with itself,
so a block of it is a row for each block of the bucket's other texts, not for
each of its own.  So no link between components is lost and no group's pairs are
written anywhere; only where many texts of a bucket share most shingles and yet
stay apart do comparisons grow with its square.  Components of few
edges come from one task, others from alternating min-label contraction, each
round cut by checkpoint().

Defined cases: a null, empty or blank text is in a class by itself.  A text of
fewer than five words has one shingle, all its words.  Repeated rows of one id
share a class.  Rows without an id are in no class.  Ids may be of any type that
sorts; other columns are not read.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import lower_az, packed, sized, table, tidy, words
from ._text import mix, shingles, slices, unique_per_text, word_hashes

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 22
ROWS = 4
#: Darts a text throws on average; 7 for each coordinate leave few coordinates empty.
DARTS = 7 * BANDS * ROWS
#: Open buckets of at most DIRECT texts are compared pair by pair, larger ones in blocks of about BLOCK.
DIRECT = 64
BLOCK = 256
#: A block of texts holds about so many bytes of shingles at most, one text at least.
BLOCK_BYTES = 1 << 25
#: Shingles of large buckets are told apart by 2**SLOTS hash slots at most, merged in ranges of 2**RANGE slots, FAN parts at a time.
SLOTS = 24
RANGE = 18
FAN = 8
#: Components of at most so many edges are found in one task, if ids are of these kinds; of more in rounds over all partitions.
FEW_EDGES = 1 << 17
_PLAIN = ("tinyint", "smallint", "int", "bigint", "string")
_LOWEST = -4  # the lowest rank cell is [0, 2**-4)
_UNIT = float(2**53)


def _uniform(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) / _UNIT


def _spans(limit: float) -> list[tuple[float, float, int]]:
    """Rank spans up to ``limit``, a power of two, and their number of cells: one below 1, then cells of length 1."""
    edges = [0.0] + [2.0**p for p in range(_LOWEST, 64) if 2.0**p <= limit]
    return [(lo, hi, max(1, int(hi - lo))) for lo, hi in zip(edges[:-1], edges[1:])]


def _poisson(u: np.ndarray, rate: float) -> np.ndarray:
    """Poisson counts from uniforms by inversion; ``rate`` is at most 1."""
    count, term, total = np.zeros(len(u), np.int64), np.exp(-rate), np.exp(-rate)
    for k in range(1, 20):
        over = u > total
        if not over.any():
            break
        count += over
        term *= rate / k
        total += term
    return count


def _throw(items: np.ndarray, weights: np.ndarray, level: int, w_lo: float, w_span: float, lo: np.ndarray, width: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Darts in one cell per item: (place, rank times ``w_span``, coordinate, identity) of those under their weight.

    The cell's weights go from ``w_lo`` over ``w_span``, its ranks, times ``w_span``, from ``lo`` over ``width``, which is its area too.
    """
    edge = lo + np.float64(level) * 2.0**40  # names the cell; exact, as ranks are short binary fractions
    seed = mix(items ^ mix(edge.view(np.uint64) + np.uint64(1)))
    count = _poisson(_uniform(seed), width)
    hit = np.flatnonzero(count)
    at = np.repeat(hit, count[hit])
    nth = np.arange(len(at)) - np.repeat(np.cumsum(count[hit]) - count[hit], count[hit])
    dart = mix(seed[at] + (nth.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    rank = lo[at] + width * _uniform(mix(dart + np.uint64(1)))
    under = w_lo + w_span * _uniform(mix(dart + np.uint64(2))) < weights[at]
    return at[under], rank[under], (mix(dart + np.uint64(3)) % np.uint64(k)).astype(np.int64)[under], dart[under]


def dart_signatures(items: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int, k: int = BANDS * ROWS, darts: int = DARTS) -> np.ndarray:
    """(n, k) earliest darts of weighted sets given as flat (item, weight, owner) rows in owner order.

    Two sets agree in a coordinate with the probability of their weighted
    Jaccard similarity.  Sets without items get zeros.
    """
    step = 256  # sets at a time: bounds the rows of short sets, which need many rank cells
    ends = np.searchsorted(owner, np.arange(0, n + step, step))
    parts = [_signatures(items[a:b], weights[a:b], owner[a:b] - i * step, min(step, n - i * step), k, darts) for i, (a, b) in enumerate(zip(ends[:-1], ends[1:])) if n > i * step]
    return np.concatenate(parts) if parts else np.zeros((0, k), np.uint64)


def _signatures(items: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int, k: int, darts: int) -> np.ndarray:
    sig, best = np.zeros(n * k, np.uint64), np.full(n * k, np.inf)
    total = np.bincount(owner, weights=weights, minlength=n)
    limit = np.zeros(n)
    full = total > 0
    limit[full] = 2.0 ** np.ceil(np.log2(darts / total[full]))
    done = np.zeros(n)
    todo = full.copy()
    while todo.any():
        live = np.flatnonzero(todo[owner])
        level, w_lo, w_span = 0, 0.0, 1.0  # weights from 0 to 1, then in octaves
        while len(live):
            top, below = limit[owner[live]] * w_span, done[owner[live]] * w_span
            for lo, hi, cells in _spans(max(top.max(), 2.0**_LOWEST)):
                at = live[(top > lo) & (below < hi)]
                if not len(at):
                    continue
                width = (hi - lo) / cells
                at = np.repeat(at, cells)
                start = np.tile(lo + width * np.arange(cells), len(at) // cells)
                i, rank, coordinate, dart = _throw(items[at], weights[at], level, w_lo, w_span, start, width, k)
                rank, mine = rank / w_span, owner[at[i]]
                inside = rank < limit[mine]
                rank, dart, slot = rank[inside], dart[inside], (mine * k + coordinate)[inside]
                order = np.lexsort((dart, rank, slot))
                slot = slot[order]
                first = np.ones(len(slot), bool)
                first[1:] = slot[1:] != slot[:-1]
                slot, first = slot[first], order[first]
                better = rank[first] < best[slot]
                best[slot[better]] = rank[first[better]]
                sig[slot[better]] = dart[first[better]]
            w_lo = w_lo + w_span
            w_span, level = w_lo, level + 1
            live = live[weights[live] > w_lo]
        done = np.where(todo, limit, done)
        todo = full & np.isinf(best.reshape(n, k)).any(axis=1)
        limit = np.where(todo, limit * 2, limit)
    return sig.reshape(n, k)


def band_keys(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    out = np.zeros((len(sig), sig.shape[1] // rows), np.uint64)
    for b in range(out.shape[1]):
        h = np.full(len(sig), np.uint64(b + 1))
        for j in range(rows):
            h = mix(h * np.uint64(31) + sig[:, b * rows + j])
        out[:, b] = h
    return out


def _text_keys(words: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit keys of each word sequence, and which texts have no words."""
    counts = np.bincount(owner, minlength=n)
    ends = np.cumsum(counts)
    place = (np.arange(len(words)) - np.repeat(ends - counts, counts)).astype(np.uint64)
    keys = []
    for salt in (1, 2):
        h = mix(words + mix(place * np.uint64(2) + np.uint64(salt)))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h, dtype=np.uint64)))
        keys.append(mix(sums[ends] - sums[ends - counts] + counts.astype(np.uint64)).view(np.int64))
    return *keys, counts == 0


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, keys array<long>): key of the words and band keys of each text with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            for lo, hi in slices(texts):
                words, owner = word_hashes(texts[lo:hi])
                k1, k2, empty = _text_keys(words, owner, hi - lo)
                items, owner, count = unique_per_text(*shingles(words, owner, SHINGLE, hi - lo))
                keys = band_keys(dart_signatures(items, count.astype(np.float64), owner, hi - lo)).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * BANDS), pa.array(keys.reshape(-1)))
                out = pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(k1), pa.array(k2), lists], names=["doc_id", "k1", "k2", "keys"])
                yield out.filter(pa.array(~empty))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").filter("doc_id IS NOT NULL").mapInArrow(run, f"doc_id {kind}, k1 long, k2 long, keys array<long>")


def occurrences(items: np.ndarray, owner: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted sets as plain ones: a value of its own for each occurrence of an item, sorted per owner.  Jaccard similarity of these sets is the weighted one."""
    if not len(count) or count.max() == 1:
        return items, owner
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    items, owner = np.repeat(items, count), np.repeat(owner, count)
    items = np.where(nth == 0, items, mix(items + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    order = np.lexsort((items, owner))
    return items[order], owner[order]


def _set_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, shingles binary): sorted 64-bit values, one for each occurrence of a shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            for lo, hi in slices(texts):
                items, owner = occurrences(*unique_per_text(*shingles(*word_hashes(texts[lo:hi]), SHINGLE, hi - lo)))
                ends = np.searchsorted(owner, np.arange(hi - lo + 1))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array([items[ends[i] : ends[i + 1]].tobytes() for i in range(hi - lo)], pa.binary())], names=["doc_id", "shingles"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, shingles binary")


def _similar(a: Column, b: Column, least: float) -> Column:
    @F.pandas_udf("boolean")
    def similar(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y):
            p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
            if min(len(p), len(q)) < least * max(len(p), len(q)):
                out.append(False)
                continue
            both = np.concatenate((p, q))
            both.sort(kind="stable")
            common = int(np.count_nonzero(both[1:] == both[:-1]))
            out.append(common >= least * (len(p) + len(q) - common))
        return pd.Series(out)

    return similar(a, b)


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    left = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a")
    both = left.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b")
    return both.filter(_similar(F.col("sa"), F.col("sb"), least)).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of an undirected edge list (a, b): the least node of the component, for every other node of it.

    Few edges are joined in one task.  Otherwise alternating large-star and
    small-star steps; a round's output is cut by checkpoint().  Stars are
    aggregates and joins, so a hub's edges may be split.
    """
    now = packed(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before is None and sums[0] <= FEW_EDGES and now.schema["u"].dataType.simpleString() in _PLAIN:
            return _joined(now)
        now = sized(now, sums[0])
        if before == sums or not sums[0]:
            return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label"))
        before = sums
        # large star: a node's larger neighbours go to its least neighbour
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        # small star: a node's smaller neighbours and itself go to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        now = packed(small.filter("u <> v").distinct())


def _joined(edges: DataFrame) -> DataFrame:
    """``components`` of edges (u, v), fresh from ``packed``, in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        ends = pa.concat_arrays([b.column(i) for i in (0, 1) for b in held]).dictionary_encode()
        order = pc.array_sort_indices(ends.dictionary)
        nodes = ends.dictionary.take(order)
        place = np.argsort(order.to_numpy())[ends.indices.to_numpy()].tolist()
        parent = list(range(len(nodes)))
        for x, y in zip(place[: len(place) // 2], place[len(place) // 2 :]):
            x, y = _find(parent, x), _find(parent, y)
            parent[max(x, y)] = min(x, y)
        label = pa.array([_find(parent, x) for x in range(len(nodes))], pa.int64())
        other = pc.not_equal(label, pa.array(np.arange(len(nodes))))
        yield pa.RecordBatch.from_arrays([nodes.filter(other), nodes.take(label).filter(other)], names=["node", "label"])

    kind = edges.schema["u"].dataType.simpleString()
    return edges.coalesce(1).mapInArrow(run, f"node {kind}, label {kind}")


def _find(parent, x):
    while parent[x] != x:
        parent[x] = x = parent[parent[x]]
    return x


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))


def near_links(texts: DataFrame, bands: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Pairs (a, b) of ids that connect just the texts that chains of verified near-duplicates connect.

    ``bands`` has (doc_id, keys) of the ids to compare, ``texts`` their texts
    (an id with several texts counts for each of them).
    """
    members = bands.select("doc_id", F.explode("keys").alias("key"))
    # aggregates by key are cut before they are joined: both sides of any size are then exchanged anew, and a large bucket may be split
    shared = packed(members.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"))
    members = packed(members.join(shared, "key").distinct())
    sets = packed(_set_rows(texts.join(members.select("doc_id").distinct(), "doc_id", "left_semi")))
    links = labels = None
    for salt in (1, 2):
        open_members = members.withColumn("label", F.col("doc_id")) if labels is None else packed(_open(_labelled(members, labels)))
        order = F.struct(F.xxhash64(F.lit(salt), "doc_id").alias("h"), "doc_id", "label")
        centres = packed(open_members.groupBy("key").agg(F.min(order).alias("c")))
        pairs = open_members.join(centres, "key").filter("label <> c.label").select(F.least("doc_id", "c.doc_id").alias("a"), F.greatest("doc_id", "c.doc_id").alias("b")).distinct()
        found = packed(_verified(packed(pairs), sets, least))
        # the stars found so far stand for their links
        links = found if labels is None else found.unionByName(labels.select(F.col("node").alias("a"), F.col("label").alias("b")))
        labels = packed(components(links))
    left = packed(_open(_labelled(members, labels)))
    few, many = _by_size(left)
    many = packed(_linkable(packed(many), sets, least))
    centres = packed(many.groupBy("key").agg(F.max(F.struct(F.col("shared") / F.col("size"), "doc_id", "label")).alias("c")))
    pairs = many.join(centres, "key").filter("label <> c.label").select(F.least("doc_id", "c.doc_id").alias("a"), F.greatest("doc_id", "c.doc_id").alias("b")).distinct()
    links = _verified(packed(pairs), sets, least).unionByName(labels.select(F.col("node").alias("a"), F.col("label").alias("b")))
    labels = packed(components(links))
    many = packed(_open(_labelled(many.select("key", "doc_id"), labels)))
    many = packed(_linkable(many, sets, least))
    few = _open(_labelled(few.select("key", "doc_id"), labels))
    fewer, many = _by_size(many)
    few = few.select("key", "doc_id", "label").unionByName(fewer.select("key", "doc_id", "label")).join(bands, "doc_id")
    last = packed(_verified(packed(_cross(few)), sets, least).unionByName(_blockwise(many, sets, least)))
    return last.unionByName(labels.select(F.col("node").alias("a"), F.col("label").alias("b")))


def _by_size(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members of buckets of at most DIRECT texts, and of larger ones."""
    large = packed(members.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > DIRECT).select("key"))
    return members.join(large, "key", "left_anti"), members.join(large, "key", "left_semi")


def _linkable(rows: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """``rows`` (key, doc_id, label) of open buckets with size and shared, without those that cannot link to another component of their bucket.

    ``shared`` is at least the number of the text's shingles that texts of other
    components hold, so at least what it has in common with any of them; a link
    needs ``least / (1 + least)`` of both sizes together.
    """
    held = packed(rows.select("doc_id", "label").distinct().join(sets, "doc_id").select("doc_id", F.xxhash64("label").alias("mark"), "shingles"))
    count, total = held.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("shingles")), F.lit(0))).first()
    bits = min(SLOTS, max(RANGE, int(total // 4).bit_length()))
    marks = held.sparkSession.sparkContext.broadcast(_marks(sized(held, count, 2000), bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slots = [_slots(np.frombuffer(x, np.uint64), bits) for x in b.column(1).to_pylist()]
            shared = [int((marks.value[x >> 3] >> (x & 7).astype(np.uint8) & 1).sum()) for x in slots]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in slots], pa.int64()), pa.array(shared, pa.int64())], names=["doc_id", "size", "shared"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    shares = packed(held.select("doc_id", "shingles").mapInArrow(run, f"doc_id {kind}, size long, shared long"))
    known = packed(rows.select("key", "doc_id", "label").join(shares, "doc_id"))
    smallest = packed(known.groupBy("key").agg(F.min("size").alias("smallest")))
    need = least / (1 + least) * (F.col("size") + F.greatest(F.col("smallest"), least * F.col("size")))
    return _open(packed(known.join(smallest, "key").filter(F.col("shared") >= need - 1e-6).drop("smallest")))


def _slots(items: np.ndarray, bits: int) -> np.ndarray:
    return (mix(items) >> np.uint64(64 - bits)).astype(np.int64)


def _ends(slot: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each slot once, with the least of its lows and the greatest of its highs."""
    if not len(slot):
        return slot, low, high
    order = np.argsort(slot, kind="stable")
    slot = slot[order]
    at = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1])))
    return slot[at], np.minimum.reduceat(low[order], at), np.maximum.reduceat(high[order], at)


def _marks(texts: DataFrame, bits: int) -> np.ndarray:
    """Bitmap of the slots that shingles of more than one component fall in; ``texts`` has (mark, shingles), mark a hash of the component.

    Parts of a range of slots are merged in a tree; the bitmap has 2**bits bits.
    """

    def rows(slot: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[int, bytes]]:
        edges = np.searchsorted(slot, np.arange(0, (1 << bits) + 1, 1 << RANGE))
        for i, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
            if b > a:
                yield i, np.stack((slot[a:b], low[a:b], high[a:b])).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = (np.zeros(0, np.int64),) * 3
        for b in batches:
            items = [np.frombuffer(x, np.uint64) for x in b.column(1).to_pylist()]
            if items:
                mark = np.repeat(b.column(0).to_numpy(), [len(x) for x in items])
                new = (_slots(np.concatenate(items), bits), mark, mark)
                held = _ends(*(np.concatenate(x) for x in zip(held, new)))
        for i, raw in rows(*held):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([i], pa.int64()), pa.array([raw], pa.binary())], names=["part", "range", "ends"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(x, np.int64).reshape(3, -1) for x in pdf["ends"]]
        ends = np.stack(_ends(*np.concatenate(parts, axis=1))).tobytes()
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0]) // FAN], "range": [int(pdf["range"].iloc[0])], "ends": [ends]})

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                slot, low, high = np.frombuffer(raw, np.int64).reshape(3, -1)
                found = np.zeros(1 << RANGE, bool)
                found[slot[low != high] - (i << RANGE)] = True
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([np.packbits(found, bitorder="little").tobytes()], pa.binary())], names=["range", "bits"])

    schema = "part long, range long, ends binary"
    now = packed(texts.select("mark", "shingles").mapInArrow(run, schema))
    while now.agg(F.max("part")).first()[0]:
        now = packed(now.groupBy("range", F.floor(F.col("part") / FAN).alias("g")).applyInPandas(merge, schema))
    out = np.zeros(1 << bits - 3, np.uint8)
    for r in now.select("range", "ends").mapInArrow(marked, "range long, bits binary").collect():  # 2**(SLOTS - RANGE) rows of 2**RANGE bits at most
        at = r["range"] << RANGE - 3
        out[at : at + (1 << RANGE - 3)] = np.frombuffer(r["bits"], np.uint8)
    return out


def _open(members: DataFrame) -> DataFrame:
    """Members of buckets that still hold more than one component."""
    mixed = packed(members.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("key"))
    return members.join(mixed, "key")


def _cross(left: DataFrame) -> DataFrame:
    """Pairs of different components, each in the first bucket that both share."""
    x = left.select("key", F.col("doc_id").alias("a"), F.col("label").alias("la"), F.col("keys").alias("ka"))
    y = left.select("key", F.col("doc_id").alias("b"), F.col("label").alias("lb"), F.col("keys").alias("kb"))
    first = F.expr("element_at(filter(ka, (k, i) -> k = kb[i]), 1) = key")
    return x.join(y, "key").filter((F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & first).select("a", "b")


def _blockwise(rows: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links between the components of large buckets, compared block against block.

    A bucket's texts are dealt into blocks of about BLOCK, those of its largest
    component apart from the others.  A task holds two blocks, one of them of
    others, and gives out links that tie its components together, never its
    pairs.  ``rows`` has (key, doc_id, label, size), size in shingles.
    """
    sums = rows.groupBy("key", "label").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    totals = F.max(F.struct("n", "label", "s")).alias("main"), F.sum("n").alias("n"), F.sum("s").alias("s")
    whole = packed(sums.groupBy("key").agg(*totals))
    blocks = lambda n, s: F.greatest(F.lit(1), F.ceil(n / BLOCK), F.ceil(s * 8 / BLOCK_BYTES)).cast("long")
    plan = whole.select("key", F.col("main.label").alias("first"), blocks(F.col("main.n"), F.col("main.s")).alias("p"), blocks(F.col("n") - F.col("main.n"), F.col("s") - F.col("main.s")).alias("q"))
    place = F.xxhash64("doc_id", "key")
    own = F.when(F.col("label") == F.col("first"), F.pmod(place, "p")).otherwise(F.col("p") + F.pmod(place, "q"))
    # a block of others is whole in each of its tasks, so it needs none for itself alone
    all_blocks = F.sequence(F.lit(0).cast("long"), F.col("p") + F.col("q") - 1)
    others = F.filter(all_blocks, lambda b: (b != F.col("own")) & ((b >= F.col("p")) | (F.col("own") >= F.col("p"))))
    dealt = rows.join(plan, "key").withColumn("own", own).withColumn("other", F.explode(others))
    tasks = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "doc_id", "label").join(sets, "doc_id")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["doc_id"].to_numpy()
        a, b = spanning_links([np.frombuffer(x, np.uint64) for x in pdf["shingles"]], pd.factorize(pdf["label"])[0], least)
        a, b = ids[a], ids[b]
        return pd.DataFrame({"a": np.where(a < b, a, b), "b": np.where(a < b, b, a)})

    kind = rows.schema["doc_id"].dataType.simpleString()
    return tasks.groupBy("key", "i", "j").applyInPandas(run, f"a {kind}, b {kind}")


def spanning_links(sets: list[np.ndarray], labels: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs at least ``least`` similar that tie together all labels that such pairs connect; one less than labels at most."""
    size = np.array([len(x) for x in sets], np.float64)
    values, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), size.astype(int))
    shared = count[column] > 1
    rank = np.cumsum(count > 1) - 1
    row, column = row[shared], rank[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    step = 1 << 13
    for lo in range(0, int((count > 1).sum()), step):
        at = slice(*np.searchsorted(column, (lo, lo + step)))
        part = np.zeros((len(sets), step), np.float32)
        part[row[at], column[at] - lo] = 1
        common += part @ part.T
    near = common >= least * (size[:, None] + size[None, :] - common) - 1e-6
    near &= labels[:, None] != labels[None, :]
    parent = {x: x for x in labels.tolist()}
    out = []
    for i, j in zip(*np.nonzero(np.triu(near, 1))):
        x, y = _find(parent, labels[i].item()), _find(parent, labels[j].item())
        if x != y:
            parent[x] = y
            out.append((i, j))
    pairs = np.array(out, np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def classes(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id) per distinct id with words: the least id of its near-duplicate class."""
    with tidy(docs.sparkSession):
        return _classes(docs, least)


def _classes(docs: DataFrame, least: float) -> DataFrame:
    keyed = packed(signed(docs))
    texts = packed(keyed.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.any_value("keys").alias("keys"), F.count("*").alias("n")))
    # a text that occurs once needs no join: its group row is the answer
    once = texts.filter("n = 1").select(F.col("rep").alias("doc_id"), "rep")
    many = keyed.select("doc_id", "k1", "k2").join(texts.filter("n > 1").select("k1", "k2", "rep"), ["k1", "k2"]).select("doc_id", "rep")
    links = near_links(docs, texts.select(F.col("rep").alias("doc_id"), "keys"), least)
    same = once.unionByName(many)
    # an id with several texts ties their groups together
    ties = same.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a <> b").select("a", "b")
    labels = packed(components(links.unionByName(ties))).select(F.col("node").alias("rep"), F.col("label").alias("class_id"))
    return same.join(labels, "rep", "left").groupBy("doc_id").agg(F.min(F.coalesce("class_id", "rep")).alias("class_id"))


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id (least id of the class), class_size of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = packed(docs.select("doc_id").join(classes(docs), "doc_id", "left").withColumn("class_id", F.coalesce("class_id", "doc_id")))
    # cut, so that both sides of the join are exchanged and a large class can be split
    sizes = packed(found.groupBy("class_id").agg(F.count("*").alias("class_size")).filter("class_size > 1"))
    many = found.join(sizes, "class_id", "left")
    return many.select("doc_id", "class_id", F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row, of the least id, of each near-duplicate class; rows without an id are in no class, but of exact copies among them one stays."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    gone = packed(classes(docs).filter("doc_id <> class_id").select("doc_id"))
    named, unnamed = docs.filter("doc_id IS NOT NULL"), docs.filter("doc_id IS NULL")
    many = packed(named.groupBy("doc_id").agg(F.count("*").alias("__n")).filter("__n > 1").select("doc_id"))
    once = named.join(gone.unionByName(many), "doc_id", "left_anti").select(*columns)
    least = F.min(F.struct(*columns)).alias("__row")
    again = named.join(many.join(gone, "doc_id", "left_anti"), "doc_id", "left_semi").groupBy("doc_id").agg(least)
    text = F.array_join(words(lower_az(F.col("text"))), " ")
    keyed = unnamed.withColumn("__text", text)
    copies = keyed.filter("__text <> ''").groupBy("__text").agg(least)
    rows = again.select("__row.*").unionByName(copies.select("__row.*"))
    return once.unionByName(rows).unionByName(keyed.filter("__text = ''").select(*columns))
