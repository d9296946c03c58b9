"""LM scoring: a gated recurrent language model over whole documents.

Token counts cover every training document: one aggregation of word hashes,
summed per task first.  The ``MODEL_WORDS`` most frequent words, the document
end and one symbol for all rarer words are the model's alphabet; the symbol's
probability is shared out among the rarer words by count + 1, so the score is a
probability of the text itself.  Counts of at most ``HEAD``
most frequent words travel with the model; all rarer words are joined exactly.
Texts are read twice: for the counts, and to be coded as model symbols, which
training and scoring read.

The network is one layer of gated recurrent units.  Its softmax is factored:
first the word's class, then the word in its class.  It starts at the unigram
distribution and is trained by truncated backpropagation over windows of
``STEPS`` tokens: in each of ``ROUNDS`` rounds every task trains on all windows of
all its training documents, end tokens included, and parameters are averaged by
tokens in a tree of fan-in ``FAN``.  Training and scoring pack documents into
lanes and carry the state from window to window through a document, so what is
learnt, and a document's likelihood, is that of its whole text.

Defined cases: a null, empty or blank text is its end token.  Repeated rows are
scored each for itself.  Without training documents every token is unknown and
the network is untrained.  An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import cut, fold, table
from ._text import slices, word_hashes

MODEL_WORDS = 4094
CLASS = 64
HEAD = 1 << 18
HIDDEN = 32
STEPS = 32
LANES = 256
#: Symbols that occur more often than so in a training step have their rows summed one symbol at a time.
SOME = 8
#: States that scoring holds at once.
BLOCK = 8192
#: Windows of one training step.
BATCH = 64
ROUNDS = 2
FAN = 8
RATE = 0.05
CLIP = 1.0
SEED = 5
#: Logits are capped here, so that their exponentials stay finite.
_TOP = np.float32(60)


def _sigmoid(x: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    np.clip(x, -30, 30, out=x)
    out = np.negative(x, out=out)
    np.exp(out, out=out)
    out += 1
    return np.reciprocal(out, out=out)


def _lanes(lengths: np.ndarray, most: int) -> list[list[int]]:
    """Sequences dealt to at most ``most`` lanes of about equal length, no more than the longest one fills."""
    lanes = int(max(1, min(most, lengths.sum() // max(1, lengths.max()) + 1)))
    heap = [(0, lane) for lane in range(lanes)]
    plan: list[list[int]] = [[] for _ in range(lanes)]
    for i in np.argsort(-lengths, kind="stable"):  # longest first, to the emptiest lane
        held, lane = heapq.heappop(heap)
        plan[lane].append(i)
        heapq.heappush(heap, (held + int(lengths[i]), lane))
    return plan


def _by_symbol(symbols: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each symbol, those below 0 left out, and the sum of its rows of ``g``."""
    order = np.argsort(symbols.astype(np.int16), kind="stable")[np.count_nonzero(symbols < 0) :]
    symbols, g = np.take(symbols, order), np.take(g, order, axis=0)
    at = np.flatnonzero(np.diff(symbols, prepend=-1))
    size = np.diff(at, append=len(order))
    by_size = np.argsort(-size, kind="stable")
    at, size = at[by_size], size[by_size]
    out = np.take(g, at, axis=0)
    often = int(np.count_nonzero(size > SOME))
    for i, (lo, n) in enumerate(zip(at[:often].tolist(), size.tolist())):
        np.matmul(np.ones(n, g.dtype), g[lo : lo + n], out=out[i])
    for k in range(1, SOME):  # the second rows of the other symbols, the third ones and so on
        last = int(np.count_nonzero(size > k))
        if last <= often:
            break
        out[often:last] += np.take(g, at[often:last] + k, axis=0)
    return symbols[at], out


class Network:
    """GRU with a class-factored softmax.  Symbol ``n - 2`` is the rare word, ``n - 1`` the end."""

    def __init__(self, counts: np.ndarray, seed: int = SEED):
        n = len(counts)
        self.n, self.classes = n, -(-n // CLASS)
        rng = np.random.default_rng(seed)
        small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        # symbols by falling count; a class is CLASS neighbours in that order
        self.order = np.argsort(-counts, kind="stable")
        self.rank = np.argsort(self.order).astype(np.int64)
        mass = np.zeros(self.classes * CLASS)
        mass[:n] = counts[self.order] + 1.0
        by_class = mass.reshape(self.classes, CLASS)
        inner = np.where(by_class > 0, np.log(np.maximum(by_class, 1e-9) / by_class.sum(1, keepdims=True)), -1e4)
        self.p = {
            "x": small(n, 3 * HIDDEN), "u": small(HIDDEN, 3 * HIDDEN) + np.tile(np.eye(HIDDEN, dtype=np.float32) * 0.5, 3),
            "c": small(HIDDEN, self.classes) * 0.1, "cb": np.log(by_class.sum(1) / mass.sum()).astype(np.float32),
            "w": small(self.classes, HIDDEN, CLASS) * 0.1, "wb": inner.astype(np.float32),
        }

    def step(self, h: np.ndarray, tokens: np.ndarray) -> tuple:
        """One step as the gates are defined; ``_forward`` does many, with fewer passes over its arrays."""
        gx, gh = self.p["x"][tokens], h @ self.p["u"]
        gates = _sigmoid(gx[:, : 2 * HIDDEN] + gh[:, : 2 * HIDDEN])
        z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
        new = np.tanh(gx[:, 2 * HIDDEN :] + r * gh[:, 2 * HIDDEN :])
        return new + z * (h - new), z, r, new, gh[:, 2 * HIDDEN :]

    def _forward(self, h: np.ndarray, tokens: np.ndarray, first: np.ndarray, keep: bool) -> tuple[np.ndarray, ...]:
        """States after each step of ``tokens`` (length, lanes), from ``h``, zero where ``first`` says that a text starts.

        With ``keep`` also what backpropagation needs, each (length, .., lanes, HIDDEN): the gates 1 - z, r and the state's
        part of n, then n, and n less the state before.  A gate is a block of its own, so that every pass runs over whole blocks.
        """
        length, lanes = tokens.shape
        kind = self.p["u"].dtype
        given = np.take(self.p["x"].reshape(-1, HIDDEN), tokens[:, None] * 3 + np.arange(3)[:, None], axis=0)
        np.negative(given[:, 1], out=given[:, 1])
        u = np.ascontiguousarray(self.p["u"].reshape(HIDDEN, 3, HIDDEN).transpose(1, 0, 2))
        u[1] *= -1  # 1 / (1 + exp(a)) is 1 - z of z's sum, and r of the negative of r's
        states = np.empty((length, lanes, HIDDEN), kind)
        gates = np.empty((length if keep else 1, 3, lanes, HIDDEN), kind)
        less = np.empty_like(states) if keep else np.empty((1, lanes, HIDDEN), kind)
        starts, part, one = first.any(1).tolist(), np.empty((lanes, HIDDEN), kind), kind.type(1)
        with np.errstate(over="ignore"):  # 1 / inf is the 0 that is meant
            for t, (x, now) in enumerate(zip(given, states)):
                if starts[t]:
                    h = np.where(first[t][:, None], kind.type(0), h)
                g, d = (gates[t], less[t]) if keep else (gates[0], less[0])
                np.matmul(h, u, out=g)
                zr, n = g[:2], x[2]
                np.add(zr, x[:2], out=zr)
                np.exp(zr, out=zr)
                np.add(zr, one, out=zr)
                np.reciprocal(zr, out=zr)
                np.multiply(g[1], g[2], out=part)
                np.add(n, part, out=n)
                np.tanh(n, out=n)
                np.subtract(n, h, out=d)
                np.multiply(d, g[0], out=part)
                h = np.add(part, h, out=now)
        return states, gates, given[:, 2], less

    def log_probs(self, h: np.ndarray, targets: np.ndarray, grad: dict | None = None) -> tuple[np.ndarray | None, np.ndarray | None]:
        """log P of each target after each state; with ``grad`` instead sets its gradients and returns d loss / d state."""
        rank = np.take(self.rank, targets)
        order = np.argsort((rank // CLASS).astype(np.int16), kind="stable")  # rows by class: each class is a slice
        rank = np.take(rank, order)
        cls, rows = rank // CLASS, np.arange(len(h))
        edge = np.searchsorted(cls, np.arange(self.classes + 1)).tolist()
        held = [(c, lo, hi) for c, (lo, hi) in enumerate(zip(edge, edge[1:])) if lo < hi]
        # the biases are the weights of a state that is always 1
        c1 = np.concatenate((self.p["c"], self.p["cb"][None]))
        w1 = np.concatenate((self.p["w"], self.p["wb"][:, None]), axis=1)
        h1 = np.empty((len(h), HIDDEN + 1), c1.dtype)
        h1[:, :HIDDEN] = np.take(h, order, axis=0)
        h1[:, HIDDEN] = 1
        total = np.zeros(len(h))
        e = h1 @ c1
        self._softmax(e, rows * self.classes + cls, total, grad)
        if grad is not None:
            g = h1.T @ e
            grad["c"][:], grad["cb"][:] = g[:HIDDEN], g[HIDDEN]
            dh = e @ self.p["c"].T
        e = np.empty((len(h), CLASS), c1.dtype)
        for c, lo, hi in held:
            np.matmul(h1[lo:hi], w1[c], out=e[lo:hi])
        self._softmax(e, rows * CLASS + rank % CLASS, total, grad)
        if grad is None:
            out = np.empty_like(total)
            out[order] = total
            return out, None
        back, down, g = np.empty_like(dh), self.p["w"].transpose(0, 2, 1), w1
        for c, lo, hi in held:
            x = e[lo:hi]
            np.matmul(x, down[c], out=back[lo:hi])
            np.matmul(h1[lo:hi].T, x, out=g[c])
        g = np.where(np.diff(edge)[:, None, None] > 0, g, 0) if len(held) < self.classes else g
        grad["w"][:], grad["wb"][:] = g[:, :HIDDEN], g[:, HIDDEN]
        dh += back
        place = np.empty_like(order)
        place[order] = rows
        return None, np.take(dh, place, axis=0)

    @staticmethod
    def _softmax(e: np.ndarray, own: np.ndarray, total: np.ndarray, grad: dict | None) -> None:
        """Adds to ``total`` log P of the logits at ``own`` (flat places); with ``grad`` turns ``e`` into d loss / d logit instead."""
        if e.size and e.max() > _TOP:
            np.minimum(e, _TOP, out=e)
        flat = e.reshape(-1)
        if grad is None:
            total += flat[own]
        np.exp(e, out=e)
        s = e @ np.ones(e.shape[1], e.dtype)
        if grad is None:
            total -= np.log(s)
        else:
            e *= np.reciprocal(s)[:, None]
            flat[own] -= 1

    def learn(self, docs: list[np.ndarray], memory: dict) -> int:
        """Train on every window of each symbol sequence, state carried to its end; the number of tokens trained on."""
        if not docs:
            return 0
        end = self.n - 1
        # a document's end is the input that the next one of its lane starts from
        streams = [np.concatenate([[end], *[docs[i] for i in sorted(lane)]]) for lane in _lanes(np.array([len(d) for d in docs]), BATCH)]
        steps = -(-(max(map(len, streams)) - 1) // STEPS) * STEPS
        tokens = np.full((len(streams), steps + 1), -1, np.int64)
        for lane, x in enumerate(streams):
            tokens[lane, : len(x)] = x
        h = np.zeros((len(streams), HIDDEN), np.float32)
        for lo in range(0, steps, STEPS):
            windows = tokens[:, lo : lo + STEPS + 1]
            h = self.train(windows, memory, h, windows[:, :-1] == end)
        return sum(map(len, docs))

    def train(self, windows: np.ndarray, memory: dict, h: np.ndarray | None = None, first: np.ndarray | None = None) -> np.ndarray:
        """One Adagrad step on windows (lanes, STEPS + 1), by backpropagation through the window.

        ``h`` is the state before it, zero where ``first`` says that a document starts; the state after it is returned.
        """
        lanes, length = windows.shape[0], windows.shape[1] - 1
        kind = self.p["u"].dtype
        grad = {k: np.zeros_like(v) for k, v in self.p.items() if k != "x"}
        h = np.zeros((lanes, HIDDEN), kind) if h is None else h
        first = np.zeros((length, lanes), bool) if first is None else np.ascontiguousarray(first.T)
        inputs, target = np.ascontiguousarray(windows[:, :-1].T), windows[:, 1:].T.reshape(-1)
        states, gates, new, less = self._forward(h, inputs, first, True)
        befores = np.empty_like(states)
        befores[0], befores[1:] = h, states[:-1]
        befores[first] = 0
        real = target >= 0
        flat = states.reshape(-1, HIDDEN)
        if real.all():
            every = self.log_probs(flat, target, grad)[1]
        else:
            every = np.zeros_like(flat)
            every[real] = self.log_probs(flat[real], target[real], grad)[1]
        every = every.reshape(states.shape)
        y, r, gh = gates[:, 0], gates[:, 1], gates[:, 2]
        z = 1 - y
        # d loss / d state times ``by`` is that of z's, r's and n's sum, of n's as far as the state's part of it goes
        by = np.empty_like(gates)
        by_z, by_r, by_s = by[:, 0], by[:, 1], by[:, 2]
        np.multiply(less, y, out=less)
        less *= z
        np.negative(less, out=by_z)
        by_n = new * new
        np.subtract(1, by_n, out=by_n)
        by_n *= y
        np.multiply(by_n, r, out=by_s)
        gh *= by_s
        np.subtract(1, r, out=r)
        np.multiply(gh, r, out=by_r)
        down = np.ascontiguousarray(self.p["u"].reshape(HIDDEN, 3, HIDDEN).transpose(1, 2, 0))
        after, parts = np.zeros((lanes, HIDDEN), kind), np.empty((3, lanes, HIDDEN), kind)
        starts, (p0, p1, p2) = first.any(1).tolist(), parts
        for t in range(length - 1, -1, -1):
            d, back = every[t], by[t]
            np.add(d, after, out=d)
            np.multiply(d, back, out=back)
            np.matmul(back, down, out=parts)
            np.multiply(d, z[t], out=after)
            np.add(p0, p1, out=p0)
            np.add(p0, p2, out=p0)
            np.add(after, p0, out=after)
            if starts[t]:
                after[first[t]] = 0
        back = np.ascontiguousarray(by.transpose(0, 2, 1, 3)).reshape(-1, 3 * HIDDEN)
        np.matmul(befores.reshape(-1, HIDDEN).T, back, out=grad["u"])
        count = kind.type(max(1, int(real.sum())) / 64)
        for k, g in grad.items():
            g /= count
            self._descend(k, slice(None), g, memory)
        np.multiply(every.reshape(-1, HIDDEN), by_n.reshape(-1, HIDDEN), out=back[:, 2 * HIDDEN :])
        rows, g = _by_symbol(inputs.reshape(-1), back)
        g /= count
        self._descend("x", rows, g, memory)
        return states[-1]

    def _descend(self, name: str, rows, g: np.ndarray, memory: dict) -> None:
        if g.size and max(g.max(), -g.min()) > CLIP:
            np.clip(g, -CLIP, CLIP, out=g)
        whole = isinstance(rows, slice)
        seen = memory[name] if whole else np.take(memory[name], rows, axis=0)
        seen += g * g
        scale = seen + 1e-6
        np.sqrt(scale, out=scale)
        np.divide(g, scale, out=g)
        g *= RATE
        if whole:
            self.p[name] -= g
        else:
            memory[name][rows] = seen
            self.p[name][rows] = np.subtract(np.take(self.p[name], rows, axis=0), g, out=g)

    def likelihood(self, docs: list[np.ndarray]) -> np.ndarray:
        """Natural log probability of each symbol sequence, state carried to its end."""
        total = np.zeros(len(docs))
        if not docs:
            return total
        lengths = np.array([len(d) for d in docs])
        plan = _lanes(lengths, LANES)
        lanes, end = len(plan), self.n - 1
        steps = max(sum(lengths[i] for i in lane) for lane in plan)
        target = np.full((steps, lanes), -1, np.int32)
        first = np.zeros((steps, lanes), bool)
        owner = np.zeros((steps, lanes), np.int32)
        for lane, held in enumerate(plan):
            at = 0
            for i in held:
                target[at : at + lengths[i], lane] = docs[i]
                owner[at : at + lengths[i], lane] = i
                first[at, lane] = True
                at += lengths[i]
        given = np.vstack((np.full((1, lanes), end, np.int32), target[:-1]))
        given[first] = end
        h = np.zeros((lanes, HIDDEN), np.float32)
        block = max(8, BLOCK // lanes)
        for lo in range(0, steps, block):
            hi = min(steps, lo + block)
            states = self._forward(h, given[lo:hi], first[lo:hi], False)[0]
            h = states[-1]
            real = target[lo:hi] >= 0
            found, _ = self.log_probs(states[real], target[lo:hi][real])
            total += np.bincount(owner[lo:hi][real], found, len(docs))
        return total


@dataclass
class Model:
    """The head of the counts, totals, and the network."""

    head: np.ndarray  # sorted word hashes
    count: np.ndarray  # their counts
    symbol: np.ndarray  # their model symbols
    ends: int
    tokens: int
    distinct: int
    rare_mass: float
    network: Network

    def lookup(self, words: np.ndarray) -> np.ndarray:
        """Place of each word in the head, -1 if it is not there."""
        if not len(self.head):
            return np.full(len(words), -1)
        unique, back = np.unique(words, return_inverse=True)
        at = np.minimum(np.searchsorted(self.head, unique), len(self.head) - 1)
        return np.where(self.head[at] == unique, at, -1)[back]

    def symbols(self, place: np.ndarray) -> np.ndarray:
        return np.where(place >= 0, self.symbol[place], self.network.n - 2).astype(np.int32) if len(self.head) else np.full(len(place), self.network.n - 2, np.int32)


def _batches(docs: DataFrame, columns: list[str], work, schema: str) -> DataFrame:
    """``work(batch, lo, hi, texts)`` on slices of the rows; yields record batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).to_pylist()
            for lo, hi in slices(texts, 1 << 22):
                yield work(b, lo, hi, texts[lo:hi])

    return docs.select("text", *columns).mapInArrow(run, schema)


def _coded_slices(b: pa.RecordBatch, limit: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """(lo, hi, symbol sequences) of slices of coded rows, cut where ``limit`` characters of their texts are reached."""
    seqs = [np.frombuffer(x, np.int16) for x in b.column("symbols").to_pylist()]
    at = np.cumsum(b.column("chars").to_numpy() + 1)
    lo = 0
    while lo < len(seqs):
        hi = min(len(seqs), int(np.searchsorted(at, (at[lo - 1] if lo else 0) + limit)) + 1)
        yield lo, hi, seqs[lo:hi]
        lo = hi


def word_counts(training: DataFrame) -> DataFrame:
    """(h, c): count of each word hash over all rows."""

    def work(b, lo, hi, texts):
        h, c = np.unique(word_hashes(texts)[0], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], names=["h", "c"])

    return _batches(training, [], work, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def _average(params: DataFrame) -> dict[str, np.ndarray] | None:
    """Token-weighted mean of (task, weight, params) rows by a tree of fan-in FAN."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        weight, mean = 0.0, None
        for w, raw in sorted(zip(pdf["weight"], pdf["params"]), key=lambda x: (x[0], x[1])):
            p = pickle.loads(raw)
            weight += w
            mean = p if mean is None else {k: mean[k] + (p[k] - mean[k]) * np.float32(w / weight) for k in p}
        return pd.DataFrame({"task": [int(pdf["task"].iloc[0]) // FAN], "weight": [weight], "params": [pickle.dumps(mean)]})

    schema = "task long, weight double, params binary"
    now = cut(params)
    while (n := now.count()) > 1:
        now = now.withColumn("task", F.dense_rank().over(_by_task()) - 1) if n <= FAN else now
        now = cut(now.groupBy(F.floor(F.col("task") / FAN).alias("g")).applyInPandas(merge, schema))
        if n <= FAN:
            now = cut(now.withColumn("task", F.lit(0).cast("long")))
    rows = now.collect()  # one row, the size of the network
    return pickle.loads(rows[0]["params"]) if rows else None


def _by_task():
    from pyspark.sql.window import Window

    return Window.orderBy("task")  # at most FAN rows


def _train_round(coded: DataFrame, model: Model) -> DataFrame:
    held = coded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        network = pickle.loads(pickle.dumps(held.value.network))
        memory = {k: np.full_like(v, 0.01) for k, v in network.p.items()}
        tokens = 0
        for b in batches:
            for _, _, seqs in _coded_slices(b, 1 << 22):
                tokens += network.learn(seqs, memory)
        if tokens:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([float(tokens)]), pa.array([pickle.dumps(network.p)], pa.binary())], names=["task", "weight", "params"])

    return coded.select("symbols", "chars").mapInArrow(run, "task long, weight double, params binary")


def count_model(training: DataFrame, counts: DataFrame) -> Model:
    """Model of the rows of ``training`` and their ``counts``, its network untrained."""
    n_docs = training.count()
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # words by size of count, in eighths of octaves: the head is every size that fits
    size = F.floor(F.log2(F.col("c").cast("double")) * 8)
    sizes = sorted((tuple(r) for r in counts.groupBy(size.alias("size")).agg(F.count("*").alias("n")).collect()), reverse=True)  # 512 rows at most
    least, held = None, 0
    for at, n in sizes:
        held += n
        if held > HEAD:
            break
        least = at
    top = counts.filter(size >= least).toPandas() if least is not None else counts.limit(0).toPandas()  # HEAD rows of 16 bytes
    top = top.sort_values(["c", "h"], ascending=[False, True])
    words = top["h"].to_numpy(np.int64).view(np.uint64)
    count = top["c"].to_numpy(np.int64)
    order = np.argsort(words)
    symbol = np.minimum(np.arange(len(words)), MODEL_WORDS)
    n = min(len(words), MODEL_WORDS) + 2
    symbol = np.where(symbol >= MODEL_WORDS, n - 2, symbol)
    known = count[: n - 2]
    rare = float(sums[0] - known.sum())
    network = Network(np.concatenate((known.astype(float), [rare, n_docs])))
    distinct = int(sums[1]) + (n_docs > 0)
    return Model(words[order], count[order], symbol[order].astype(np.int32), n_docs, int(sums[0]) + n_docs, distinct, rare + (int(sums[1]) - len(known)) + 1.0, network)


def fit(coded: DataFrame, model: Model, rounds: int = ROUNDS) -> None:
    """Train the network of ``model`` on all rows of ``coded``."""
    for _ in range(rounds):
        if (p := _average(_train_round(coded, model))) is not None:
            model.network.p = p


def code(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, hash, chars, symbols, far, n_tokens, n_known, base, shared) of ``docs`` (doc_id, held_out, text).

    A text is split and looked up here once for all rounds and the score: ``symbols`` holds its model symbols (2 bytes each)
    with the end, ``far`` the hashes of its words outside the head, ``shared`` what rare words of the head get of their symbol.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    keyed = docs.select("doc_id", "held_out", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"))

    def work(b, lo, hi, texts):
        m = held.value
        words, owner = word_hashes(texts)
        place = m.lookup(words)
        symbols = m.symbols(place)
        n_texts = hi - lo
        n_words = np.bincount(owner, minlength=n_texts)
        ends = np.cumsum(n_words)
        near = place >= 0
        logs = np.zeros(len(words))
        if near.any():
            logs[near] = np.log10(m.count[place[near]] + 1.0)
        by_doc = lambda x, at: np.bincount(owner[at], x[at], n_texts)
        none = symbols == m.network.n - 2
        rare_near = by_doc(logs, none & near) if len(words) else np.zeros(n_texts)
        n_rare = np.bincount(owner[none], minlength=n_texts)
        base = (by_doc(logs, near) if len(words) else np.zeros(n_texts)) + np.log10(m.ends + 1.0) - (n_words + 1) * np.log10(m.tokens + m.distinct + 1.0)
        known = np.bincount(owner[near], minlength=n_texts) + (m.ends > 0)
        coded = np.insert(symbols, ends, m.network.n - 1).astype(np.int16)
        long = lambda x: pa.array(np.asarray(x).astype(np.int64))
        return pa.RecordBatch.from_arrays(
            [
                *[b.column(k).slice(lo, n_texts) for k in (1, 2, 3)], long([len(t or "") for t in texts]), _binary(coded, ends + np.arange(1, n_texts + 1)),
                _binary(words[~near], np.cumsum(np.bincount(owner[~near], minlength=n_texts))), long(n_words + 1), long(known), pa.array(base), pa.array(rare_near - n_rare * np.log10(m.rare_mass)),
            ],
            names=["doc_id", "held_out", "hash", "chars", "symbols", "far", "n_tokens", "n_known", "base", "shared"],
        )

    kind = keyed.schema["doc_id"].dataType.simpleString()
    return _batches(keyed, ["doc_id", "held_out", "hash"], work, f"doc_id {kind}, held_out boolean, hash long, chars long, symbols binary, far binary, n_tokens long, n_known long, base double, shared double")


def _binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes of ``values`` as one binary for each end."""
    offsets = np.concatenate(([0], ends * values.itemsize)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def score(coded: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """``coded`` rows as (doc_id, held_out, n_tokens, n_known, base_score, score)."""
    held = coded.sparkSession.sparkContext.broadcast(model)

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            far = b.column("far").to_pylist()
            hashes = np.frombuffer(b"".join(far), np.uint64)
            pairs = np.empty(len(hashes), [("o", np.int64), ("h", np.uint64)])
            pairs["o"], pairs["h"] = np.repeat(np.arange(len(far)), [len(x) // 8 for x in far]), hashes
            pairs = pairs[np.lexsort((pairs["h"], pairs["o"]))]
            new = np.ones(len(pairs), bool)
            new[1:] = pairs[1:] != pairs[:-1]
            at = np.flatnonzero(new)
            n = np.diff(np.concatenate((at, [len(pairs)])))
            take = pa.array(pairs["o"][at])
            yield pa.RecordBatch.from_arrays([pa.array(pairs["h"][at].view(np.int64)), b.column("doc_id").take(take), b.column("hash").take(take), pa.array(n.astype(np.int32))], names=["h", "doc_id", "hash", "n"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = held.value.network
        for b in batches:
            for lo, hi, seqs in _coded_slices(b, 1 << 24):
                out = b.slice(lo, hi - lo).drop_columns(["symbols", "chars", "shared"])
                yield out.append_column("model", pa.array(network.likelihood(seqs) / np.log(10) + b.column("shared").to_numpy()[lo:hi]))

    kind = coded.schema["doc_id"].dataType.simpleString()
    tail = coded.select("doc_id", "hash", "far").filter(F.length("far") > 0).mapInArrow(rare, f"h long, doc_id {kind}, hash long, n int")
    found = tail.join(counts, "h").groupBy("doc_id", "hash").agg(F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("logs"), F.sum("n").alias("hits"))
    # equal rows (same id and text) add up above; their number divides the sums again
    same = coded.groupBy("doc_id", "hash").agg(F.count("*").alias("copies")).filter("copies > 1")
    found = found.withColumnsRenamed({"doc_id": "__id", "hash": "__hash"})
    same = same.withColumnsRenamed({"doc_id": "__id2", "hash": "__hash2"})
    found = found.join(same, F.col("__id").eqNullSafe(F.col("__id2")) & (F.col("__hash") == F.col("__hash2")), "left").select("__id", "__hash", (F.col("logs") / F.coalesce("copies", F.lit(1))).alias("logs"), (F.col("hits") / F.coalesce("copies", F.lit(1))).cast("long").alias("hits"))
    main = coded.select("doc_id", "held_out", "hash", "n_tokens", "n_known", "base", "symbols", "chars", "shared").mapInArrow(whole, f"doc_id {kind}, held_out boolean, hash long, n_tokens long, n_known long, base double, model double")
    out = main.join(found, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("hash") == F.col("__hash")), "left")
    logs = F.coalesce("logs", F.lit(0.0))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("hits", F.lit(0))).alias("n_known"), (F.col("base") + logs).alias("base_score"), (F.col("model") + logs).alias("score"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", (fold("doc_id", 7) == 2).alias("held_out"), "text")
    training = docs.filter("NOT held_out")
    counts = cut(word_counts(training))
    model = count_model(training, counts)
    coded = cut(code(docs, model))
    fit(coded.filter("NOT held_out"), model)
    return score(coded, model, counts).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
