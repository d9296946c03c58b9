"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts and benchmark items are lower-cased and white space runs become one
space.  Every q-gram of a document is looked up among the items' q-grams; a hit
lies on a diagonal (document position minus item position).  Hits are counted in
diagonal bands that overlap by half.  By the q-gram lemma, ``w`` characters of
an item with at most ``e`` edits share ``w - q + 1 - q e`` q-grams with their
copy inside one band, so an item window with fewer hits there is dropped without
looking at the text.  Every window that is left is aligned around its band;
a document is contaminated if a window of ``WINDOW`` characters (or the whole
item, if shorter) aligns within the edit budget.

The benchmark is the query set: it is held in blocks of about ``BLOCK_CHARS``
characters, each block one pass over the documents, which are never shuffled; of
a pass only the hits are kept.  Texts go through in pieces of bounded length that
overlap, and the hits of frequent q-grams are taken in tiles of bounded size that
overlap too, so memory is bounded and no window is lost.

Defined cases: null or empty texts have no hits; items that are null or blank are
not looked for; items shorter than ``MIN_CHARS`` characters carry little evidence
and are looked for, exactly and as whole words, only with ``short``, as the query
and the pipeline do; items without an id are looked for and reported with a null
id; repeated items report the least id; repeated documents are judged each for
itself; ids may be of any type.  Empty tables give empty results or nothing
contaminated.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ._spark import attach, cut, table
from ._text import CHUNK

Q = 10
WINDOW = 64
EDITS = 0.07
MIN_CHARS = 24
BLOCK_CHARS = 4_000_000
#: Hits of q-grams that are held at once.
HITS = 1 << 20
_TABLE_BITS = 22


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _qgrams(codes: np.ndarray, q: int) -> np.ndarray:
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    wide = codes.astype(np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(q):
        h *= np.uint64(0x100000001B3)
        h += wide[k : k + n]
    return h * np.uint64(0x9E3779B97F4A7C15)


def _ranges(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo, lo + 1, ... of each of ``n`` numbers, one after the other."""
    return np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())


@dataclass
class Index:
    """q-grams of a block of items, sorted, with a bit table for quick misses; and short items by their text."""

    ids: list
    items: list[np.ndarray]
    q: int
    window: int
    rate: float
    short: dict[str, object] = field(default_factory=dict)

    def __post_init__(self):
        size = np.array([len(x) for x in self.items], np.int64)
        grams = [_qgrams(x, self.q) for x in self.items]
        flat = np.concatenate([np.zeros(0, np.uint64), *grams])
        order = np.argsort(flat, kind="stable")
        self.grams, at = np.unique(flat[order], return_index=True)
        self.first = np.append(at, len(flat))
        self.flat = order  # by q-gram, then by place
        self.offset = np.cumsum([0, *(len(g) for g in grams)])  # of an item's q-grams
        self.codes = np.concatenate([np.zeros(0, np.uint32), *self.items])
        self.start = np.cumsum(np.append(0, size))  # of an item's characters
        self.bits = np.zeros(1 << _TABLE_BITS, bool)
        self.bits[(flat >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True
        self.width = np.minimum(self.window, size)
        self.budget = (self.rate * self.width).astype(np.int64)
        self.least = np.maximum(1, self.width - self.q + 1 - self.q * self.budget)
        self.half = int(self.budget.max(initial=0)) + 1
        self.reach = int(self.width.max(initial=0)) + self.half  # the hits of a window lie in so many characters
        self.key = None
        self.short_words = sorted({x.count(" ") + 1 for x in self.short})

    def matches(self, codes: np.ndarray, owner_starts: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, document position, item position, edits) of a verified window per text and item: the first by place in the item, then in the text.

        ``codes`` are several texts, each followed by ``q`` separators.  Texts of
        very many hits are worked on in tiles, in order; there the first tile's.
        """
        h = _qgrams(codes, self.q)
        at = np.flatnonzero(self.bits[(h >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])
        if not len(at) or not len(self.grams):
            return
        gram = np.minimum(np.searchsorted(self.grams, h[at]), len(self.grams) - 1)
        hit = self.grams[gram] == h[at]
        at, gram = at[hit], gram[hit]
        n = self.first[gram + 1] - self.first[gram]
        text = np.searchsorted(owner_starts, at, side="right") - 1
        edges = np.flatnonzero(np.diff(text, prepend=-1, append=-2))  # a text's hits are neighbours
        sums = np.add.reduceat(n, edges[:-1]) if len(at) else np.zeros(0, np.int64)
        lo = held = 0
        for k in range(len(sums) + 1):
            if k == len(sums) or held + sums[k] > HITS:
                if k > lo and held <= HITS:
                    part = slice(edges[lo], edges[k])
                    yield from self._verified(codes, owner_starts, at[part], self.first[gram[part]], n[part], text[part], set())
                elif k > lo:  # one text of more hits
                    part = slice(edges[lo], edges[k])
                    yield from self._tiles(codes, owner_starts, at[part], gram[part], 0, len(self.flat), int(text[edges[lo]]), set())
                lo, held = k, 0
            if k < len(sums):
                held += sums[k]

    def _tiles(self, codes, owner_starts, at, gram, p0: int, p1: int, text: int, found: set) -> Iterator[tuple[int, int, int, int, int]]:
        """Matches of one text's hits with q-grams from ``p0`` up to ``p1`` of the block; halves overlap, so that each window lies in one."""
        if p0 == 0 and p1 == len(self.flat):
            lo, hi = self.first[gram], self.first[gram + 1]
        else:
            if self.key is None:
                self.key = np.repeat(np.arange(len(self.grams)), np.diff(self.first)) * len(self.flat) + self.flat
            lo, hi = np.searchsorted(self.key, gram * len(self.flat) + p0), np.searchsorted(self.key, gram * len(self.flat) + p1)
        n = hi - lo
        some = n > 0
        at, gram, lo, n = at[some], gram[some], lo[some], n[some]
        if not len(at):
            return
        if n.sum() > HITS and at[-1] - at[0] > 4 * self.reach:
            middle = (at[-1] + at[0]) // 2
            for part in (at < middle + self.reach, at >= middle):
                yield from self._tiles(codes, owner_starts, at[part], gram[part], p0, p1, text, found)
        elif n.sum() > HITS and p1 - p0 > 4 * self.reach:
            middle = (p0 + p1) // 2
            for a, b in ((p0, middle + self.reach), (middle, p1)):
                yield from self._tiles(codes, owner_starts, at, gram, a, b, text, found)
        else:
            yield from self._verified(codes, owner_starts, at, lo, n, np.full(len(at), text), found)

    def _verified(self, codes, owner_starts, at, lo, n, text, found: set) -> Iterator[tuple[int, int, int, int, int]]:
        """Matches from hits: ``n`` places of the block from ``lo`` on at each position ``at``; those of (text, item) in ``found`` are left out, new ones added."""
        pos, text = np.repeat(at, n), np.repeat(text, n)
        flat = self.flat[_ranges(lo, n)]
        item = np.searchsorted(self.offset, flat, side="right") - 1
        place = flat - self.offset[item]
        diagonal = pos - place
        windows = []
        for shift in (0, self.half):  # bands of width 2 * half, overlapping by half
            band = (diagonal + shift) // (2 * self.half)
            order = np.lexsort((place, band, item, text))
            t, i, b, p = text[order], item[order], band[order], place[order]
            last = np.arange(len(order)) + self.least[i] - 1
            ok = last < len(order)
            end = np.minimum(last, len(order) - 1)
            room = self.width[i] - self.q
            ok &= (t[end] == t) & (i[end] == i) & (b[end] == b) & (p[end] - p <= room)
            t, i, b, p, x = t[ok], i[ok], b[ok], p[ok], np.maximum(0, (p[end] - room)[ok])
            # windows that hold these hits, from the first that ends late enough to the last that begins early enough, once for each band
            most = np.minimum(p, np.diff(self.start)[i] - self.width[i])
            x = np.minimum(x, most)
            same = np.zeros(len(x), bool)
            same[1:] = (t[1:] == t[:-1]) & (i[1:] == i[:-1]) & (b[1:] == b[:-1])
            x[1:] = np.where(same[1:], np.maximum(x[1:], most[:-1] + 1), x[1:])
            count = most - x + 1
            centre = b * 2 * self.half - shift + self.half
            rows = np.repeat(np.arange(len(x)), count)
            windows.append(np.stack((t[rows], i[rows], _ranges(x, count), centre[rows]), axis=1))
        windows = np.concatenate(windows)
        if not len(windows):
            return
        windows = windows[np.lexsort(windows.T[::-1])]
        new = np.flatnonzero(np.any(np.diff(windows[:, :2], axis=0, prepend=-1) != 0, axis=1))  # first window of each text and item
        sizes = np.diff(np.append(new, len(windows)))
        keys = windows[new, :2].tolist()
        open_ = [k for k, key in enumerate(keys) if tuple(key) not in found]
        done, step = 0, 1
        while open_:  # few windows of all pairs first, as most true pairs need no more
            live = np.array(open_)
            take = np.minimum(sizes[live] - done, step)
            rows = _ranges(new[live] + done, take)
            edits, where = self._aligned(codes, windows[rows])
            hit, ends = edits <= self.budget[windows[rows, 1]], np.cumsum(take)
            still = []
            for k, a, b in zip(open_, ends - take, ends):
                good = np.flatnonzero(hit[a:b])
                if len(good):
                    t, i, x, _ = windows[rows[a + good[0]]].tolist()
                    found.add((t, i))
                    yield t, i, max(0, int(where[a + good[0]]) - int(owner_starts[t])), x, int(edits[a + good[0]])
                elif sizes[k] > done + step:
                    still.append(k)
            done, step, open_ = done + step, step * 4, still

    def _aligned(self, codes: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edits and about where of (text, item, item position, diagonal) rows."""
        edits, where = np.zeros(len(windows), np.int64), windows[:, 2] + windows[:, 3]
        for w in np.unique(self.width[windows[:, 1]]):
            rows = np.flatnonzero(self.width[windows[:, 1]] == w)
            budget = int(self.rate * w)
            for lo in range(0, len(rows), 2048):
                r = windows[rows[lo : lo + 2048]]
                patterns = self.codes[(self.start[r[:, 1]] + r[:, 2])[:, None] + np.arange(w)]
                edits[rows[lo : lo + 2048]] = banded_each(patterns, codes, r[:, 2] + r[:, 3], budget, self.half + budget)
        return edits, where

    def short_matches(self, clean: str) -> Iterator[tuple[object, int, int, int]]:
        """(id, position, 0, 0) of each short item that stands in ``clean`` as whole words."""
        words = clean.split(" ")
        starts = np.cumsum([0, *(len(w) + 1 for w in words)])
        seen = set()
        for k in self.short_words:
            for i in range(len(words) - k + 1):
                piece = words[i] if k == 1 else " ".join(words[i : i + k])
                if piece in self.short and piece not in seen:
                    seen.add(piece)
                    yield self.short[piece], int(starts[i]), 0, 0


def banded(pattern: np.ndarray, codes: np.ndarray, at: int, budget: int) -> int:
    """Least edits turning ``pattern`` into a run of ``codes`` that starts within ``budget`` of ``at``; budget + 1 if more."""
    return int(banded_each(pattern[None, :], codes, np.array([at]), budget)[0])


def banded_each(patterns: np.ndarray, codes: np.ndarray, at: np.ndarray, budget: int, reach: int | None = None) -> np.ndarray:
    """``banded`` of each row of ``patterns`` at each place of ``at``, for runs that start within ``reach``, ``budget`` if it is not given."""
    length = patterns.shape[1]
    side = budget + (budget if reach is None else reach)  # start shift of +-reach, path drift of +-budget
    steps = np.arange(2 * side + 1, dtype=np.int32)
    here = (at - side)[:, None] + np.arange(length + 2 * side)
    text = np.where((here >= 0) & (here < len(codes)), codes[np.clip(here, 0, len(codes) - 1)].astype(np.int64), -1)
    row = np.zeros((len(at), len(steps)), np.int32)  # free start anywhere in the band
    for k in range(length):
        new = row + (text[:, k : k + len(steps)] != patterns[:, k, None])
        new[:, :-1] = np.minimum(new[:, :-1], row[:, 1:] + 1)  # pattern character left out
        row = np.minimum.accumulate(new - steps, axis=1) + steps  # extra text characters
        if k % 8 == 7 and row.min() > budget:
            break
    return np.minimum(row.min(1), budget + 1).astype(np.int64)


def blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[object, str]]]:
    """The items, normalised, in blocks of about ``block_chars`` characters (one item at least), fetched one at a time.

    Items are dealt by hash; blocks over twice that size are dealt anew, into twice as many.
    """
    items = cut(benchmark.filter("text IS NOT NULL").groupBy("text").agg(F.min("item_id").alias("id")))
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // block_chars))
    while True:
        dealt = items.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(n)))
        sizes = dealt.groupBy("block").agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("items"))
        if n == 1 or not sizes.filter((F.col("chars") > 2 * block_chars) & (F.col("items") > 1)).limit(1).count():
            break
        n *= 2
    for (block,) in sizes.select("block").orderBy("block").collect():
        least: dict[str, object] = {}
        for r in dealt.filter(F.col("block") == block).collect():  # block_chars bounds it
            if text := normal(r["text"]):
                least[text] = r["id"] if least.get(text) is None else least[text] if r["id"] is None else min(least[text], r["id"])
        yield sorted(((i, t) for t, i in least.items()), key=lambda x: x[1])


def _pieces(clean: list[str], overlap: int) -> Iterator[tuple[list[int], list[int], list[str]]]:
    """Texts in passes of about CHUNK characters: owner, offset and text of each piece; longer texts in overlapping pieces."""
    owner, offset, parts, held = [], [], [], 0
    for i, text in enumerate(clean):
        for at in range(0, max(1, len(text) - overlap), CHUNK):
            owner.append(i)
            offset.append(at)
            parts.append(text[at : at + CHUNK + overlap])
            held += len(parts[-1])
            if held >= CHUNK:
                yield owner, offset, parts
                owner, offset, parts, held = [], [], [], 0
    if parts:
        yield owner, offset, parts


def _found(index: Index, texts: list[str | None]) -> list[list[dict]]:
    """The matches of each text, one for each item, by item and place."""
    gap, out = "\x00" * index.q, [[] for _ in texts]
    clean = [normal(t) for t in texts]
    seen: set[tuple[int, int]] = set()
    for owner, offset, parts in _pieces(clean, index.reach + 2 * index.half):
        starts = np.cumsum([0, *(len(t) + index.q for t in parts)])[:-1]
        for piece, item, pos, place, edits in index.matches(_codes(gap.join(parts) + gap), starts):
            if (owner[piece], item) not in seen:
                seen.add((owner[piece], item))
                out[owner[piece]].append((item, {"item_id": index.ids[item], "pos": pos + offset[piece], "item_pos": place, "edits": edits}))
    for i, text in enumerate(clean if index.short else ()):
        out[i] += [(len(index.ids), dict(zip(("item_id", "pos", "item_pos", "edits"), m))) for m in index.short_matches(text)]
    return [[m for _, m in sorted(x, key=lambda y: y[0])] for x in out]


def _kind(benchmark: DataFrame) -> T.ArrayType:
    long = lambda n: T.StructField(n, T.LongType())
    return T.ArrayType(T.StructType([T.StructField("item_id", benchmark.schema["item_id"].dataType), long("pos"), long("item_pos"), long("edits")]))


def _scan(docs: DataFrame, held, to: str, kind: T.ArrayType, columns: list[str], only_hits: bool) -> DataFrame:
    """``columns`` of ``docs`` with the matches in ``to``; ``held`` is a broadcast index, which ``block_chars`` bounds."""
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = b.select(columns)
            found = _found(held.value, b.column(b.schema.get_field_index("text")).to_pylist())
            rows = pa.RecordBatch.from_arrays([*out.columns, pa.array(found, arrow)], schema=pa.schema([*out.schema, pa.field(to, arrow)]))
            yield rows.filter(pa.array([len(x) > 0 for x in found], pa.bool_())) if only_hits else rows

    fields = [docs.schema[c] for c in columns]
    return docs.mapInArrow(run, T.StructType([*fields, T.StructField(to, kind)]))


def matches(docs: DataFrame, benchmark: DataFrame, q: int = Q, window: int = WINDOW, rate: float = EDITS, to: str = "found", short: bool = False) -> DataFrame:
    """``docs`` with ``to``: array of the benchmark items in each text, with place and edits.  A benchmark of several blocks needs ``doc_id``."""
    kind, parts = _kind(benchmark), []
    name = F.lit(None).cast(kind)
    columns = [c for c in docs.columns if c != to]
    whole = docs.select(*[F.col(f"`{c}`") for c in columns])

    def indexed(block):
        long = [(i, t) for i, t in block if len(t) >= max(MIN_CHARS, q)]
        few = {t: i for i, t in block if len(t) < max(MIN_CHARS, q)} if short else {}
        return docs.sparkSession.sparkContext.broadcast(Index([i for i, _ in long], [_codes(t) for _, t in long], q, window, rate, few))

    found = list(_two(blocks(benchmark)))
    if isinstance(found[0], list):
        return _scan(whole, indexed(found[0]), to, kind, columns, False)
    keyed = whole.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    for block in found[0]:
        held = indexed(block)
        parts.append(cut(_scan(keyed, held, "found", kind, ["doc_id", "text_hash"], True).dropDuplicates(["doc_id", "text_hash"])))
        held.destroy()
    hits = reduce(DataFrame.unionByName, parts).groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_list("found")).alias("found"))
    return attach(whole, hits, "found", to).withColumn(to, F.coalesce(to, F.array().cast(kind), name))


def _two(all_blocks: Iterator[list]) -> Iterator:
    """The only block (an empty one if there is none), or an iterator over all of several."""
    first = next(all_blocks, [])
    second = next(all_blocks, None)
    yield first if second is None else _again(first, second, all_blocks)


def _again(first: list, second: list, rest: Iterator[list]) -> Iterator[list]:
    yield first
    yield second
    yield from rest


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, contaminated, n_items, item_ids, least edits of every document."""
    found = matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), short=True)
    return found.select(
        "doc_id", (F.size("found") > 0).alias("contaminated"), F.size("found").cast("long").alias("n_items"),
        F.array_sort(F.transform("found", lambda x: x["item_id"])).alias("item_ids"), F.array_min(F.transform("found", lambda x: x["edits"])).alias("edits"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, short: bool = False) -> DataFrame:
    """``docs`` without the documents that hold a benchmark passage."""
    return matches(docs, benchmark, to="__found", short=short).filter(F.size("__found") == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
