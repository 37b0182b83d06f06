"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

Input of a word is two vectors: one of the word itself (hashed), and the mean of vectors
of its character n-grams (hashed; prefixes, suffixes and all inner trigrams). A run of
more than ``PIECE`` letters is read as overlapping pieces, each a word. Two gated
recurrent layers read a window of words forwards and backwards, attention pools their
states, and a logistic unit gives the window's probability. A text is cut into windows
that overlap by half, whatever its length, and is toxic if any window is: its
probability is one minus the product of the windows' complements. Labels of whole texts
train that directly.

Training reads a bounded sample of labelled rows (``Settings.toxic_rows`` and
``clean_rows``) in one task; the driver gets the weights alone, about a megabyte. Scoring
is one pass over the table; word vectors are projected once per distinct word in a
worker's bounded cache.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.text import as_strings, chunks, mix64

_WORD = re.compile(r"[^\W\d_]+")
THRESHOLD = 0.3


@dataclass(frozen=True)
class Settings:
    """Sizes of the network and bounds of its training."""

    window: int = 32
    stride: int = 16
    hidden: int = 8
    word_dim: int = 6
    char_dim: int = 10
    word_rows: int = 1 << 13
    char_rows: int = 1 << 14
    #: Labelled rows that training may read, chosen by hash of their id.
    toxic_rows: int = 1000
    clean_rows: int = 2000
    #: Characters of the longest text among them; what training holds is bounded by all three.
    text_chars: int = 250_000
    steps: int = 300
    batch_docs: int = 18
    #: Windows of a clean text, and of a toxic one, that a step looks at; of longer texts
    #: each step draws others.
    step_windows: int = 64
    toxic_windows: int = 1024
    rate: float = 0.01
    #: Of the word and n-gram tables: what is added to Adam's divisor, and weight decay.
    table_floor: float = 1e-3
    table_decay: float = 0.1
    char_scale: float = 0.05
    gram_drop: float = 0.2
    seed: int = 7


# ---- inputs -----------------------------------------------------------------

#: Letters of the longest word that is read as one.
PIECE = 24
#: Letters of a piece of longer ones, and from one to the next.
PART, PART_STRIDE = 12, 4
_PREFIXES = (2, 3, 4, 5, 6, 7)
_SUFFIXES = (3, 4)
_TRIGRAMS = PIECE - 3
_GRAMS = len(_PREFIXES) + len(_SUFFIXES) + _TRIGRAMS


def words_of(text: str) -> list[str]:
    """The runs of letters of a text, those of more than ``PIECE`` letters in overlapping pieces."""
    words = _WORD.findall(text.lower())
    if max(map(len, words), default=0) <= PIECE:
        return words
    return [p for w in words for p in ([w] if len(w) <= PIECE else (w[k : k + PART] for k in range(0, len(w) - PART + PART_STRIDE, PART_STRIDE)))]


def word_inputs(words: list[str], s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of each word vector, rows of its n-grams (0: none), and one over their number.

    Words have ``PIECE`` letters at most, and their n-grams cover every letter.
    """
    n = len(words)
    whole = np.array([hash_text(w) for w in words], np.uint64)
    codes = np.zeros((n, PIECE), np.uint64)
    raw = np.array(words, dtype=f"U{PIECE}").view(np.uint32).reshape(n, PIECE) if n else codes
    codes[:] = raw
    length = np.array([len(w) for w in words], np.int64)
    grams = np.zeros((n, _GRAMS), np.int32)
    column = 0

    def put(h: np.ndarray, kind: int, valid: np.ndarray) -> None:
        nonlocal column
        grams[:, column] = np.where(valid, 1 + (mix64(h + np.uint64(kind * 7919)) % np.uint64(s.char_rows - 1)).astype(np.int32), 0)
        column += 1

    rolling = np.zeros(n, np.uint64)
    prime = np.uint64(1099511628211)
    for k in range(max(_PREFIXES)):
        rolling = (rolling ^ codes[:, k]) * prime
        if k + 1 in _PREFIXES:
            put(rolling, 1, length > k)
    at = np.arange(n)
    for m in _SUFFIXES:
        h = np.zeros(n, np.uint64)
        for k in range(m):
            h = (h ^ codes[at, np.maximum(length - m + k, 0)]) * prime
        put(h, 2, length >= m)
    for k in range(min(_TRIGRAMS, max(length.max(initial=0) - 3, 0))):
        h = np.zeros(n, np.uint64)
        for j in range(3):
            h = (h ^ codes[:, k + 1 + j]) * prime
        put(h, 3, length >= k + 4)
    scale = (1.0 / np.maximum((grams > 0).sum(axis=1), 1)).astype(np.float32)
    return (whole % np.uint64(s.word_rows)).astype(np.int64), grams, scale


def hash_text(word: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word)


def window_spans(ends: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every window: the place of its first word, where its text ends, and its text."""
    counts = np.diff(ends)
    n = np.where(counts > 0, 1 + np.maximum(0, -(-(counts - s.window) // s.stride)), 0)
    owner = np.repeat(np.arange(len(counts)), n)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    return ends[:-1][owner] + nth * s.stride, ends[1:][owner], owner


def window_rows(ids: np.ndarray, start: np.ndarray, stop: np.ndarray, s: Settings) -> np.ndarray:
    """Word rows of the windows at ``start`` (0: padding); ``ids`` count from 1."""
    at = start[:, None] + np.arange(s.window)
    inside = at < stop[:, None]
    return np.where(inside, ids[np.minimum(at, len(ids) - 1)], 0) if len(ids) else np.zeros(at.shape, np.int64)


def window_index(ids: np.ndarray, ends: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Word rows of every window of a few texts, and the text of each."""
    start, stop, owner = window_spans(ends, s)
    return window_rows(ids, start, stop, s), owner


# ---- network ----------------------------------------------------------------


@dataclass
class Network:
    """Weights, and the two numbers that calibrate a text's log-odds."""

    s: Settings
    p: dict[str, np.ndarray] = field(default_factory=dict)
    slope: float = 1.0
    shift: float = 0.0

    @staticmethod
    def new(s: Settings) -> Network:
        rng, h, d = np.random.default_rng(s.seed), s.hidden, s.word_dim + s.char_dim
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        p = {
            "word": draw(s.word_rows, s.word_dim, scale=0.01), "char": draw(s.char_rows, s.char_dim, scale=s.char_scale),
            "wx": draw(d, 2, 3 * h, scale=d**-0.5), "bx": np.zeros((2, 3 * h), np.float32),
            "u": draw(2, h, 3 * h, scale=h**-0.5), "bn": np.zeros((2, 1, h), np.float32),
            "wa": draw(2 * h, h, scale=(2 * h) ** -0.5), "ba": np.zeros(h, np.float32), "va": draw(h, scale=h**-0.5),
            "wo": draw(2 * h, scale=0.5), "bo": np.array([-4.0], np.float32),
        }
        p["char"][0] = 0
        return Network(s, p)

    def vectors(self, word: np.ndarray, grams: np.ndarray, scale: np.ndarray) -> np.ndarray:
        return np.hstack([self.p["word"][word], self.p["char"][grams].sum(axis=1) * scale[:, None]])

    def project(self, vectors: np.ndarray) -> np.ndarray:
        """Gate inputs of both directions, (words, 2, 3 hidden)."""
        d = vectors.shape[1]
        return (vectors @ self.p["wx"].reshape(d, -1)).reshape(len(vectors), 2, -1) + self.p["bx"]

    def forward(self, gates: np.ndarray, index: np.ndarray, keep: bool = False):
        """Log-odds of every window; with ``keep`` also what :meth:`backward` needs.

        ``gates`` has the padding's row first.
        """
        p, h_dim, (n, length) = self.p, self.s.hidden, index.shape
        mask = (index > 0).astype(np.float32)
        x = np.stack([gates[index, 0], gates[index[:, ::-1], 1]])  # 2, n, length, 3h
        m = np.stack([mask, mask[:, ::-1]])[..., None]
        h, states, saved = np.zeros((2, n, h_dim), np.float32), [], []
        for t in range(length):
            a = h @ p["u"]
            xt = x[:, :, t]
            zr = 0.5 * np.tanh(0.5 * (xt[..., : 2 * h_dim] + a[..., : 2 * h_dim])) + 0.5
            z, r = zr[..., :h_dim], zr[..., h_dim:]
            inner = a[..., 2 * h_dim :] + p["bn"]
            c = np.tanh(xt[..., 2 * h_dim :] + r * inner)
            new = (c + z * (h - c)) * m[:, :, t]
            if keep:
                saved.append((h, z, r, inner, c))
            h = new
            states.append(h)
        out = np.concatenate([np.stack([s[0] for s in states], 1), np.stack([s[1] for s in states[::-1]], 1)], axis=2)  # n, length, 2h
        hidden = np.tanh(out @ p["wa"] + p["ba"])
        e = np.where(mask > 0, hidden @ p["va"], -1e9)
        w = np.exp(e - e.max(axis=1, keepdims=True))
        w /= w.sum(axis=1, keepdims=True)
        pooled = (out * w[..., None]).sum(axis=1)
        logit = pooled @ p["wo"] + p["bo"][0]
        return (logit, (index, m, saved, out, hidden, w, pooled)) if keep else logit

    def backward(self, d_logit: np.ndarray, kept) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the weights, and of the gate inputs at (direction, window, place)."""
        p, h_dim, (index, m, saved, out, hidden, w, pooled) = self.p, self.s.hidden, kept
        g = {"wo": pooled.T @ d_logit, "bo": d_logit.sum(keepdims=True)}
        d_pooled = d_logit[:, None] * p["wo"]
        d_w = (out * d_pooled[:, None]).sum(axis=2)
        d_e = w * (d_w - (w * d_w).sum(axis=1, keepdims=True))
        d_hidden = d_e[..., None] * p["va"] * (1 - hidden * hidden)
        g["va"] = (hidden * d_e[..., None]).sum(axis=(0, 1))
        g["wa"] = out.reshape(-1, 2 * h_dim).T @ d_hidden.reshape(-1, h_dim)
        g["ba"] = d_hidden.sum(axis=(0, 1))
        d_out = w[..., None] * d_pooled[:, None] + d_hidden @ p["wa"].T
        length = index.shape[1]
        d_x = np.empty((2, len(index), length, 3 * h_dim), np.float32)
        g["u"], g["bn"] = np.zeros_like(p["u"]), np.zeros_like(p["bn"])
        d_h = np.zeros((2, len(index), h_dim), np.float32)
        u_t = p["u"].transpose(0, 2, 1)
        for t in range(length - 1, -1, -1):
            h, z, r, inner, c = saved[t]
            d_h = (d_h + np.stack([d_out[:, t, :h_dim], d_out[:, length - 1 - t, h_dim:]])) * m[:, :, t]
            d_z, d_c = d_h * (h - c) * z * (1 - z), d_h * (1 - z) * (1 - c * c)
            d_r = d_c * inner * r * (1 - r)
            d_inner = d_c * r
            d_a = np.concatenate([d_z, d_r, d_inner], axis=2)
            d_x[:, :, t] = np.concatenate([d_z, d_r, d_c], axis=2)
            g["u"] += h.transpose(0, 2, 1) @ d_a
            g["bn"] += d_inner.sum(axis=1, keepdims=True)
            d_h = d_h * z + d_a @ u_t
        return g, d_x

    def calibrated(self, log_clean: np.ndarray) -> np.ndarray:
        """Scores from the logarithm of the probability that no window is toxic."""
        toxic = -np.expm1(np.minimum(log_clean, -1e-9))
        odds = np.log(np.maximum(toxic, 1e-9)) - np.maximum(log_clean, -30.0)
        return 1.0 / (1.0 + np.exp(-(self.slope * odds + self.shift)))


def log_complement(logit: np.ndarray) -> np.ndarray:
    """log(1 - probability) of each window."""
    return -np.logaddexp(0.0, logit.astype(np.float64))


# ---- training ---------------------------------------------------------------


class _Adam:
    def __init__(self, p: dict[str, np.ndarray], s: Settings):
        self.p, self.floor, self.decay, self.n = p, s.table_floor, s.table_decay, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}

    def step(self, g: dict[str, np.ndarray], rate: float) -> None:
        self.n += 1
        for k, d in g.items():
            self.m[k] += 0.1 * (d - self.m[k])
            self.v[k] += 0.01 * (d * d - self.v[k])
            table = k in ("word", "char")  # of rare rows a small gradient must stay a small step
            move = (self.m[k] / (1 - 0.9**self.n)) / (np.sqrt(self.v[k] / (1 - 0.99**self.n)) + (self.floor if table else 1e-6))
            self.p[k] -= rate * move
            if table:
                self.p[k][:, 1:] *= 1 - rate * self.decay


def train(texts: list[str], toxic: list[int], s: Settings | None = None) -> Network:
    """Fit a network to labelled texts; one without both labels gives a constant score."""
    s = s or Settings()
    net, rng = Network.new(s), np.random.default_rng(s.seed + 1)
    y = np.array(toxic, np.int64)
    if len(y) == 0 or y.min() == y.max():
        rate = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.1
        net.slope, net.shift = 0.0, float(np.log(rate / (1 - rate)))
        return net
    vocab: dict[str, int] = {}
    ids, ends = [], [0]
    for t in texts:
        ids += [vocab.setdefault(w, len(vocab)) for w in words_of(t)]
        ends.append(len(ids))
    word, grams, scale = word_inputs(list(vocab), s)
    # Columns that no word of the sample is long enough for
    grams = grams[:, : max(1, np.flatnonzero(grams.any(axis=0)).max(initial=0) + 1)]
    ids, ends = np.array(ids, np.int32), np.array(ends)
    del vocab
    start, stop, owner = window_spans(ends, s)
    first = np.searchsorted(owner, np.arange(len(texts) + 1))
    # A fifth of the texts calibrates, the rest trains.
    held = rng.permutation(len(y)) < len(y) // 5
    pools = [np.flatnonzero((y == k) & ~held & (np.diff(first) > 0)) for k in (0, 1)]
    if min(map(len, pools)) == 0:
        pools = [np.flatnonzero((y == k) & (np.diff(first) > 0)) for k in (0, 1)]
    if min(map(len, pools)) == 0:
        net.slope, net.shift = 0.0, float(np.log(y.mean() / (1 - y.mean())))
        return net
    _set_evidence(net, ids, ends, y, held, word, grams)
    places = ids + 1
    del ids
    adam = _Adam(net.p, s)
    for step in range(s.steps):
        n_toxic = s.batch_docs // 3
        docs = np.concatenate([rng.choice(pools[1], n_toxic), rng.choice(pools[0], s.batch_docs - n_toxic)])
        picked, weight, group = [], [], []
        for k, d in enumerate(docs):
            a, b = first[d], first[d + 1]
            own = np.arange(a, b)
            most = s.toxic_windows if y[d] else s.step_windows
            if b - a > most:
                own = rng.choice(own, most, replace=False)
            picked.append(own)
            weight.append(np.full(len(own), 1.0 if y[d] else (b - a) / len(own)))
            group.append(np.full(len(own), k))
        picked, weight, group = np.concatenate(picked), np.concatenate(weight), np.concatenate(group)
        rows = window_rows(places, start[picked], stop[picked], s)
        used, local = np.unique(rows[rows > 0] - 1, return_inverse=True)
        compact = np.zeros_like(rows)
        compact[rows > 0] = local + 1
        drop = rng.random(len(used)) < 0.5  # half of the words are known by their characters only
        seen = np.where(rng.random((len(used), grams.shape[1])) < s.gram_drop, 0, grams[used])
        vec = net.vectors(word[used], seen, scale[used]).astype(np.float32)
        vec[drop, 1 : s.word_dim] = 0
        gates = np.concatenate([np.zeros((1, 2, 3 * s.hidden), np.float32), net.project(vec)])
        logit, kept = net.forward(gates, compact, keep=True)
        prob = 1 / (1 + np.exp(-logit.astype(np.float64)))
        clean = np.exp(np.minimum(np.bincount(group, log_complement(logit), len(docs)), -1e-9))
        label = y[docs][group]
        d_logit = np.where(label == 1, -np.minimum(clean / (1 - clean), 20.0)[group] * prob, prob * weight)
        g, d_x = net.backward((d_logit / len(docs)).astype(np.float32), kept)
        d_gates = np.zeros_like(gates)
        for k, where in ((0, compact), (1, compact[:, ::-1])):
            flat, values = where.reshape(-1), d_x[k].reshape(-1, 3 * s.hidden)
            order = np.argsort(flat, kind="stable")
            starts = np.flatnonzero(np.append(True, flat[order][1:] != flat[order][:-1]))
            d_gates[flat[order][starts], k] = np.add.reduceat(values[order], starts, axis=0)
        d_gates = d_gates[1:].reshape(len(used), -1)
        g["wx"] = (vec.T @ d_gates).reshape(net.p["wx"].shape)
        g["bx"] = d_gates.sum(axis=0).reshape(2, -1)
        d_vec = d_gates @ net.p["wx"].reshape(vec.shape[1], -1).T
        d_vec[drop, 1 : s.word_dim] = 0
        g["word"], g["char"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["char"])
        np.add.at(g["word"], word[used], d_vec[:, : s.word_dim])
        flat = seen.reshape(-1)
        np.add.at(g["char"], flat, np.repeat(d_vec[:, s.word_dim :] * scale[used][:, None], grams.shape[1], axis=0))
        g["char"][0] = 0
        g["word"][:, 0] = g["char"][:, 0] = 0
        adam.step(g, s.rate * min(1.0, 2.0 * (1 - step / s.steps)))
        net.p["char"][0] = 0
    _calibrate(net, y, held, word, grams, scale, places, (start, stop, owner))
    return net


def _set_evidence(net: Network, ids, ends, y, held, word, grams) -> None:
    """Start the first column of both tables at what document counts say, and keep it there.

    It is the z-score of the share of toxic texts that hold a word or n-gram over that of
    clean ones, one toxic text discounted, so that what a single text holds says nothing.
    """
    n1, n0 = max(1, (y[~held] == 1).sum()), max(1, (y[~held] == 0).sum())
    counts = {name: np.zeros((2, len(net.p[name]))) for name in ("word", "char")}
    for text in np.flatnonzero(~held):
        seen = np.unique(ids[ends[text] : ends[text + 1]])
        for name, rows in (("word", word[seen]), ("char", grams[seen])):
            counts[name][y[text], np.unique(rows)] += 1
    for name, (clean, toxic) in counts.items():
        a = np.maximum(toxic - 1.0, 0.0)
        share = (a + clean + 1.0) / (n1 + n0 + 2.0)
        z = (a / n1 - clean / n0) / np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0))
        net.p[name][:, 0] = np.clip(z, -3.0, 12.0) / 4.0
    net.p["char"][0] = 0


def _calibrate(net: Network, y, held, word, grams, scale, places, spans) -> None:
    """Logistic fit of the log-odds of texts that did not train (of all, where too few)."""
    start, stop, owner = spans
    gates = np.zeros((len(word) + 1, 2, 3 * net.s.hidden), np.float32)
    for a in range(0, len(word), 4096):
        gates[a + 1 : a + 4097] = net.project(net.vectors(word[a : a + 4096], grams[a : a + 4096], scale[a : a + 4096]))
    logit = np.zeros(len(owner), np.float32)
    for a in range(0, len(owner), 1024):
        logit[a : a + 1024] = net.forward(gates, window_rows(places, start[a : a + 1024], stop[a : a + 1024], net.s))
    log_clean = np.bincount(owner, log_complement(logit), len(y))
    toxic = -np.expm1(np.minimum(log_clean, -1e-9))
    odds = np.log(np.maximum(toxic, 1e-9)) - np.maximum(log_clean, -30.0)
    use = held if min((y[held] == 0).sum(), (y[held] == 1).sum()) >= 5 else np.ones(len(y), bool)
    # A grid over slope and shift, with a weak pull to (1, 0), cannot run away on texts
    # that separate well.
    x, t = odds[use][:, None, None], y[use][:, None, None]
    slope, shift = np.linspace(0.1, 2.0, 39)[:, None], np.linspace(-6.0, 6.0, 97)[None]
    z = slope * x + shift
    loss = (np.logaddexp(0.0, z) - t * z).sum(axis=0) + 0.5 * (slope - 1) ** 2 + 0.05 * shift**2
    i, j = np.unravel_index(np.argmin(loss), loss.shape)
    net.slope, net.shift = float(slope[i, 0]), float(shift[0, j])


# ---- Spark ------------------------------------------------------------------


def held_out(doc_id: Column) -> Column:
    """Rows kept for evaluation: crc32 of the id's text leaves 2 modulo 4; a null id does not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, s: Settings) -> DataFrame:
    """(doc_id, text, toxic) of at most ``toxic_rows`` and ``clean_rows`` labelled rows that are not
    held out, without texts of more than ``text_chars`` characters.

    Rows are chosen by hash of their id; an id labelled twice counts as toxic if either
    label is. The ids are bounded by those parameters, so they are broadcast.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id")
    chosen = known.where("toxic > 0").orderBy(order, "doc_id").limit(s.toxic_rows).unionAll(known.where("toxic <= 0").orderBy(order, "doc_id").limit(s.clean_rows))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.join(F.broadcast(chosen), "doc_id").where(F.length("text") <= s.text_chars).groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))


def fitted(docs: DataFrame, labels: DataFrame, s: Settings | None = None) -> Network:
    """The network trained on :func:`training_sample`, in one task whose memory goes with it."""
    s = s or Settings()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        net = train([text for _, text, _ in rows], [int(toxic > 0) for _, _, toxic in rows], s)
        yield pa.record_batch([pa.array([pickle.dumps(net)], pa.binary())], names=["net"])

    row = training_sample(docs, labels, s).repartition(1).mapInArrow(run, "net binary").first()
    return pickle.loads(row[0]) if row else train([], [], s)


class _Scorer(dict):
    """Scores texts; maps words to rows of a growing table of gate inputs."""

    LIMIT = 120_000

    def __init__(self, net: Network):
        super().__init__()
        self.net = net
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.pending: list[str] = []
        # Zeros take no memory until written, so room for all words spares growing copies.
        self.gates = np.zeros((self.LIMIT + (1 << 16), 2, 3 * self.net.s.hidden), np.float32)

    def __missing__(self, word: str) -> int:
        self[word] = row = len(self) + 1
        self.pending.append(word)
        return row

    def scores(self, texts: list[str]) -> np.ndarray:
        if len(self) > self.LIMIT:
            self.reset()
        split = [words_of(t) for t in texts]
        ends = np.concatenate([[0], np.cumsum([len(w) for w in split])]).astype(np.int64)
        find = self.__getitem__
        ids = np.fromiter((i for words in split for i in map(find, words)), np.int64, int(ends[-1]))
        if self.pending:
            begin, stop = len(self) + 1 - len(self.pending), len(self) + 1
            if stop > len(self.gates):
                self.gates = np.concatenate([self.gates[:begin], np.zeros((2 * stop - begin, *self.gates.shape[1:]), np.float32)])
            self.gates[begin:stop] = self.net.project(self.net.vectors(*word_inputs(self.pending, self.net.s)))
            self.pending = []
        log_clean = np.zeros(len(texts))
        # Few texts at a time, so that the windows of a very long one are cut up too.
        start, stop, owner = window_spans(ends, self.net.s)
        for a in range(0, len(owner), 1024):
            rows = window_rows(ids, start[a : a + 1024], stop[a : a + 1024], self.net.s)
            log_clean += np.bincount(owner[a : a + 1024], log_complement(self.net.forward(self.gates, rows)), len(texts))
        return self.net.calibrated(log_clean)


def score_texts(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(shared.value)
        for batch in batches:
            texts = as_strings(batch.column(1))
            out = [scorer.scores(part.to_pylist()) for _, part in chunks(texts, 1 << 20)]
            yield pa.record_batch([batch.column(0), pa.array(np.concatenate(out) if out else np.zeros(0))], names=["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def score_documents(docs: DataFrame, labels: DataFrame, s: Settings | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    The text alone decides a score; a null text is an empty one. Repeated rows get equal
    scores. Without labels of both kinds every score is the labels' rate (0.1 without
    any). Other columns are ignored.
    """
    net = fitted(docs, labels, s)
    scored = score_texts(docs, net)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, s: Settings | None = None) -> DataFrame:
    """The documents whose score is below the threshold; all columns stay.

    Scores are made in the same pass as the rows, so nothing is joined.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, s))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(shared.value)
        for batch in batches:
            out = [scorer.scores(part.to_pylist()) for _, part in chunks(as_strings(batch.column("text")), 1 << 20)]
            yield batch.filter(pa.array(np.concatenate(out) < THRESHOLD)) if out else batch

    return docs.mapInArrow(run, docs.schema)
