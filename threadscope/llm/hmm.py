"""Language-model scoring: a hidden Markov model trained by Baum-Welch on the whole corpus.

Vocabulary. Every training word is counted. The ``SYMBOLS`` most frequent are emitted by the states
themselves; other words belong to a class by their count (one class per factor of two), and a state
emits the class: ``P(word | state) = P(class | state) * (c + 0.5) / mass of the class``. Words never
seen are one type, as in the base score; by Good-Turing it weighs as much as all words seen once, and
shares the last class with the words that aren't sent to the tasks. A text's last token is the end.

Counts of the most frequent words, at most ``KNOWN``, are sent to the tasks. Rarer ones stay in a table and meet
the texts' rare words in a join.

Recursions run over all texts of a batch at once: a text is cut into chunks of 64 tokens, the scaled
product of a chunk's transition-and-emission matrices is formed for all chunks in step, and products
are chained per text. That gives the exact likelihood and, for training, the exact state vectors at
every chunk border, from which forward and backward passes inside all chunks run in step again.
Expected counts are summed per task and added up by Spark.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACED, arrow_map, as_long, byte_rows, id_and_text, saved, word_hashes

STATES = 4
SYMBOLS = 8192
KNOWN = 1 << 18
ROUNDS = 4
CLASSES = 64
CHUNK = 64
PRIOR = 1000.0
_SLAB = 4096
_END = np.uint64(0x656E64206F662074)


# ---------------------------------------------------------------- recursions

class Model:
    """Start, transition (states x states) and emission (states x symbols) probabilities."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def initial(cls, weights: np.ndarray, states: int = STATES, seed: int = 7) -> Model:
        """Symbols by weight, each state with deviations of its own."""
        rng = np.random.default_rng(seed)
        emit = (weights + 1e-9) * rng.uniform(0.5, 1.5, (states, len(weights)))
        move = np.full((states, states), 0.2 / states) + 0.8 * np.eye(states)
        return cls(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))


class _Chunks:
    """Symbol sequences (none empty) cut into chunks of CHUNK, laid out text after text."""

    def __init__(self, texts: list[np.ndarray]):
        sizes = np.array([len(t) for t in texts])
        self.per_text = -(-sizes // CHUNK)
        self.first = np.cumsum(self.per_text) - self.per_text
        n = int(self.per_text.sum())
        self.symbols = np.zeros((n, CHUNK), np.int32)
        flat = self.symbols.reshape(-1)
        for t, at in zip(texts, self.first):
            flat[at * CHUNK:at * CHUNK + len(t)] = t
        self.used = np.full(n, CHUNK)
        self.used[self.first + self.per_text - 1] = sizes - (self.per_text - 1) * CHUNK
        self.begins = np.zeros(n, bool)
        self.begins[self.first] = True

    def _slabs(self, model: Model):
        """Some chunks at a time, longest first: (rows, symbols (steps x chunks), how many chunks reach each
        step, which begin a text, emission probabilities (states x steps x chunks)). States come before chunks
        in all arrays, so that every step works on long contiguous rows."""
        order = np.argsort(-self.used, kind="stable")
        for s in range(0, len(order), _SLAB):
            rows = order[s:s + _SLAB]
            used = self.used[rows]
            steps = int(used[0])
            reach = len(rows) - np.searchsorted(used[::-1], np.arange(steps), side="right")
            symbols = np.ascontiguousarray(self.symbols[rows, :steps].T, np.intp)
            yield rows, symbols, reach.tolist(), self.begins[rows], model.emit.take(symbols, axis=1)

    def products(self, model: Model) -> tuple[np.ndarray, np.ndarray]:
        """Scaled matrix product of every chunk and the log of its scale."""
        n, k = len(self.symbols), len(model.start)
        out, log = np.empty((n, k, k)), np.zeros(n)
        into = np.ascontiguousarray(model.move.T)
        for rows, _, reach, begins, seen in self._slabs(model):
            m = np.where(begins, np.eye(k)[:, :, None], model.move[:, :, None]) * seen[:, 0]
            new = np.empty_like(m)
            for t, on in enumerate(reach):
                now = m[:, :, :on]
                if t:
                    np.matmul(into, now, out=new[:, :, :on])
                    np.multiply(new[:, :, :on], seen[:, t, :on], out=now)
                if t % 16 == 15 or t == len(reach) - 1:
                    scale = m.sum((0, 1))
                    m /= scale
                    log[rows] += np.log(scale)
            out[rows] = m.transpose(2, 0, 1)
        return out, log

    def log_likelihood(self, model: Model) -> np.ndarray:
        products, log = self.products(model)
        return self._chain(model, products, log)[1]

    def _chain(self, model: Model, products: np.ndarray, log: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The state vector that enters every chunk, and the log-likelihood of every text."""
        enter = np.empty((len(products), len(model.start)))
        now = np.broadcast_to(model.start, (len(self.first), len(model.start))).copy()
        total = np.zeros(len(self.first))
        for j in range(int(self.per_text.max(initial=0))):
            on = np.flatnonzero(self.per_text > j)
            at = self.first[on] + j
            enter[at] = now[on]
            new = (now[on][:, None, :] @ products[at])[:, 0, :]
            scale = new.sum(1)
            now[on] = new / scale[:, None]
            total[on] += np.log(scale) + log[at]
        return enter, total

    def expected(self, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected starts, moves and emissions (states x symbols), and the log-likelihood."""
        k, n = len(model.start), len(self.symbols)
        products, log = self.products(model)
        enter, total = self._chain(model, products, log)
        leave = np.empty((n, k))
        now = np.ones((len(self.first), k))
        for j in reversed(range(int(self.per_text.max(initial=0)))):
            on = np.flatnonzero(self.per_text > j)
            at = self.first[on] + j
            leave[at] = now[on]
            new = (products[at] @ now[on][:, :, None])[:, :, 0]
            now[on] = new / new.sum(1, keepdims=True)
        width = model.emit.shape[1]
        starts, moves, emits = np.zeros(k), np.zeros((k, k)), np.zeros((k, width))
        into = np.ascontiguousarray(model.move.T)
        for rows, symbols, reach, begins, seen in self._slabs(model):
            steps, m = symbols.shape
            alpha, scale = np.empty((steps, k, m)), np.empty((steps, m))
            entered = np.ascontiguousarray(enter[rows].T)
            for t, on in enumerate(reach):
                a = alpha[t, :, :on]
                if t:
                    np.matmul(into, alpha[t - 1, :, :on], out=a)
                else:
                    a[:] = np.where(begins, entered, into @ entered)
                a *= seen[:, t, :on]
                a /= a.sum(0, out=scale[t, :on])
            # backward vectors have the forward scale and alpha . beta = 1 where a chunk ends, so that it is 1 everywhere
            beta = np.ascontiguousarray(leave[rows].T)
            post, done = np.zeros((k, steps, m)), 0
            for t in reversed(range(steps)):
                on = reach[t]
                beta[:, done:on] /= (alpha[t, :, done:on] * beta[:, done:on]).sum(0)
                done = on
                np.multiply(alpha[t, :, :on], beta[:, :on], out=post[:, t, :on])
                weighted = seen[:, t, :on] * beta[:, :on]
                weighted /= scale[t, :on]
                if t:
                    moves += alpha[t - 1, :, :on] @ weighted.T
                    np.matmul(model.move, weighted, out=beta[:, :on])
                else:
                    moves += entered[:, ~begins] @ weighted[:, ~begins].T
                    starts += post[:, 0, begins].sum(1)
            at = symbols.reshape(-1)
            for z in range(k):
                emits[z] += np.bincount(at, post[z].reshape(-1), width)
        return starts, moves * model.move, emits, float(total.sum())


def _groups(column: pa.Array):
    """Symbol arrays of a binary column, some 200,000 tokens at a time: (rows, arrays)."""
    rows, texts, size = [], [], 0
    for i, raw in enumerate(byte_rows(column)):
        t = raw.view("<u2")
        rows.append(i)
        texts.append(t)
        size += len(t)
        if size >= 200_000:
            yield rows, texts
            rows, texts, size = [], [], 0
    if rows:
        yield rows, texts


def train(symbols: DataFrame, weights: np.ndarray, states: int = STATES, rounds: int = ROUNDS,
          unseen: float = 0.0) -> tuple[Model, list[float]]:
    """Baum-Welch over all rows (syms: u16 LE symbols); the model and the log-likelihood before each round.

    ``weights`` (the symbols' shares) are a prior worth PRIOR tokens in every state; ``unseen`` tokens of
    the last symbol are divided among the states by their share of the text.
    """
    model, seen = Model.initial(weights, states), []
    width = len(weights)
    schema = "part int, " + ", ".join(f"c{z} double" for z in range(states))

    def run(batches):
        m = sent.value
        starts, moves, emits, total = np.zeros(states), np.zeros((states, states)), np.zeros((states, width)), 0.0
        for batch in batches:
            for _, texts in _groups(batch.column("syms")):
                a, b, c, d = _Chunks(texts).expected(m)
                starts, moves, emits, total = starts + a, moves + b, emits + c, total + d
        at = np.flatnonzero(emits.any(0))
        table = np.concatenate([emits[:, at], starts[:, None], moves, np.full((states, 1), total / states)], 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([at, width + np.arange(states + 2)]).astype(np.int32)), *(pa.array(x) for x in table)],
            names=["part", *(f"c{z}" for z in range(states))])

    for _ in range(rounds):
        sent = symbols.sparkSession.sparkContext.broadcast(model)
        sums = arrow_map(symbols.select("syms"), run, schema).groupBy("part").agg(
            *(F.sum(f"c{z}").alias(f"c{z}") for z in range(states))).toPandas()
        full = np.zeros((states, width + states + 2))
        full[:, sums["part"].to_numpy(np.int64)] = sums[[f"c{z}" for z in range(states)]].to_numpy().T
        emits, starts, moves = full[:, :width], full[:, width] + 0.01, full[:, width + 1:width + 1 + states] + 0.01
        share = (emits.sum(1) + 1e-9) / (emits.sum() + states * 1e-9)
        emits = emits + PRIOR * weights
        emits[:, -1] += unseen * share
        seen.append(float(full[:, -1].sum()))
        model = Model(starts / starts.sum(), moves / moves.sum(1, keepdims=True), emits / emits.sum(1, keepdims=True))
    return model, seen


# ---------------------------------------------------------------- words

def count_words(texts: DataFrame) -> DataFrame:
    """h (hash), c of all words of ``texts`` and of the end of each."""

    def run(batches):
        for batch in batches:
            words, ends = [], 0
            for text in byte_rows(batch.column("text")):
                words.append(word_hashes(text, SPACED))
                ends += 1
            h, c = np.unique(np.concatenate([*words, np.full(ends, _END)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(as_long(h)), pa.array(c.astype(np.int64))], names=["h", "c"])

    return arrow_map(texts, run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


class _Words:
    """Lookup of the known words: count and symbol; the rest has the last symbol."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, symbols: np.ndarray, unknown: int):
        order = np.argsort(hashes)
        self.hashes, self.counts, self.symbols = hashes[order], counts[order], symbols[order]
        self.unknown = unknown

    def __call__(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """count (-1 where the word isn't known here), symbol."""
        if not len(self.hashes):
            return np.full(len(words), -1), np.full(len(words), self.unknown)
        at = np.minimum(np.searchsorted(self.hashes, words), len(self.hashes) - 1)
        hit = self.hashes[at] == words
        return np.where(hit, self.counts[at], -1), np.where(hit, self.symbols[at], self.unknown)


def score(docs: DataFrame, folds: int = 5, out: int = 1, id_col: str = "doc_id", text_col: str = "text",
          states: int = STATES, rounds: int = ROUNDS, symbols: int = SYMBOLS, known: int = KNOWN) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs``.

    Rows whose crc32 of the id as text is ``out`` modulo ``folds`` are held out of training. Tokens are
    the words between ASCII white space, A-Z lower-cased, then one end; null and empty texts are the end
    alone. ``base_score`` is the add-0.5 unigram log10 probability; ``score`` the model's. Null ids are
    not held out; repeated rows count and are scored each; an empty table gives no rows.
    """
    spark = docs.sparkSession
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == out, F.lit(False))
    texts = id_and_text(docs, id_col, text_col).withColumn("held_out", held)

    vocabulary = saved(count_words(texts.where("not held_out").select("text")), "words")
    n_all, v_all, once = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1)), F.count(F.when(F.col("c") == 1, 1))).first()
    unseen = max(float(once), 0.5)
    # counts by eighths of a power of two: the words above the lowest step that leaves at most `known`
    step = F.floor(8 * F.log2("c")).cast("int")
    steps = vocabulary.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values("step", ascending=False)
    fits = steps[steps["n"].cumsum() <= known]["step"]
    end = F.col("h") == int(_END.view(np.int64))  # every document has one: known whatever its count
    top = vocabulary.where((step >= (int(fits.min()) if len(fits) else 1 << 20)) | end).toPandas()
    top = top.sort_values(["c", "h"], ascending=[False, True])
    hashes, counts = top["h"].to_numpy(np.int64).view(np.uint64), top["c"].to_numpy(np.int64)
    # symbols: 0 the end, then the most frequent words, then classes by count, last the words not sent
    width = symbols + CLASSES + 2
    order = np.arange(len(hashes))
    symbol = np.where(order < symbols, order + 1, symbols + 1 + np.minimum(np.log2(np.maximum(counts, 1)), CLASSES - 1).astype(np.int64))
    symbol[hashes == _END] = 0
    weights, mass = np.zeros(width), np.zeros(width)
    np.add.at(weights, symbol, counts)
    np.add.at(mass, symbol, counts + 0.5)
    weights[-1] = mass[-1] = n_all - counts.sum() + unseen
    own = np.zeros(width, bool)
    own[:symbols + 1] = True  # one word, or the end: the state emits the word itself
    smooth = (weights + 0.5) / (weights + 0.5).sum()
    floor = np.log10(n_all + 0.5 * (v_all + 1))
    within = np.where(own, 0.0, -np.log10(np.maximum(mass, 0.5)))
    sent = spark.sparkContext.broadcast((hashes, counts, symbol, own, within, float(floor)))

    def encode(batches):
        hashes, counts, symbol, own, within, floor = sent.value
        words_of = _Words(hashes, counts, symbol, len(own) - 1)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = []
                for text in byte_rows(part.column("text")):
                    words = np.append(word_hashes(text, SPACED), _END)
                    c, s = words_of(words)
                    here = s < len(own) - 1
                    log_c = np.log10(c[here] + 0.5)
                    if not here[-1]:
                        s[-1] = 0  # an end never seen in training is still the end
                    rare, times = np.unique(words[:-1][~here[:-1]], return_counts=True)
                    shared = ~own[s[here]]
                    rows.append((len(words), int(here.sum()), float((log_c - floor).sum()) + (0.0 if here[-1] else float(np.log10(0.5) - floor)),
                                 float(log_c[shared].sum() + within[s[here][shared]].sum()), s.astype("<u2").tobytes(),
                                 as_long(rare), times))
                offsets = np.concatenate(([0], np.cumsum([len(r[5]) for r in rows], dtype=np.int32))).astype(np.int32)
                rare = pa.StructArray.from_arrays([pa.array(np.concatenate([r[5] for r in rows])), pa.array(np.concatenate([r[6] for r in rows]).astype(np.int64))],
                                                  names=["h", "m"])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array([r[0] for r in rows], pa.int64()),
                     pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows]), pa.array([r[3] for r in rows]),
                     pa.array([r[4] for r in rows], pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), rare)],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "base", "within", "syms", "rare"])

    encoded = arrow_map(texts, encode, "doc_id long, held_out boolean, n_tokens long, n_known long, base double, within double, "
                                       "syms binary, rare array<struct<h: long, m: long>>")
    rows = saved(encoded.withColumn("row", F.monotonically_increasing_id()), "symbols")
    model, _ = train(rows.where("not held_out"), smooth, states, rounds, unseen)
    final = spark.sparkContext.broadcast(model)

    def likelihood(batches):
        m = final.value
        for batch in batches:
            ll = np.zeros(batch.num_rows)
            for at, texts in _groups(batch.column("syms")):
                ll[at] = _Chunks(texts).log_likelihood(m)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "doc_id", "held_out", "n_tokens", "n_known", "base", "within")),
                                              pa.array(ll / np.log(10))],
                                             names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "within", "ll"])

    scored = arrow_map(rows.drop("rare"), likelihood, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, "
                                                      "base double, within double, ll double")
    rare = rows.select("row", F.inline("rare")).join(vocabulary, "h", "left").groupBy(F.col("row").alias("r")).agg(
        F.sum(F.col("m") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("log_c"), F.sum("m").alias("m"),
        F.sum(F.col("m") * F.log10(F.coalesce(F.col("c").cast("double"), F.lit(unseen)))).alias("log_w"),
        F.sum(F.when(F.col("c") > 0, F.col("m")).otherwise(0)).alias("seen"))
    some = lambda c: F.coalesce(F.col(c), F.lit(0))
    return scored.join(rare, F.col("row") == F.col("r"), "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + some("seen")).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + some("log_c") - some("m") * F.lit(float(floor))).alias("base_score"),
        (F.col("ll") + F.col("within") + some("log_w") + some("m") * F.lit(float(within[-1]))).alias("score"))
