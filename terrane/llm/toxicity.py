"""Toxic spans by a linear-chain conditional random field.

Two labels, plain and toxic, form a chain over the words of a text. A word's
potential is a sum of weights of hashed features: itself, its beginnings and
endings, its shape, and its neighbours. Forward and backward messages give each
word's marginal; words above a threshold make spans with their offsets, and a
calibrated sum of the marginals is the document's score.

Labels are given for documents only. Words and beginnings of words that explain
toxic documents and hardly occur in others are found by greedy covering, and
label the tokens the field learns from.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrane.llm.common import WORD_TABLE, batch_of, content_words, crc32_of_id, gram_hashes, hash_words, id_type, map_batches, schema, slices

#: Bounds of the sample that the model is fitted on: labelled documents of each class, and characters of one.
TOXIC_SAMPLE, PLAIN_SAMPLE, SAMPLE_CHARS = 1500, 3000, 20_000
DIMENSIONS = 1 << 18
THRESHOLD = 0.3
_NEUTRAL = -12.0  # log odds of a text without words


def features(word: bytes) -> list[bytes]:
    w = word.decode("utf-8", "replace")
    n = len(w)
    shape = ("d" if any(c.isdigit() for c in w) else "a") + str(min(n, 12))
    return [f.encode() for f in (
        f"w={w}", *(f"p{k}={w[:k]}" for k in (3, 4, 5, 6) if n >= k), *(f"s{k}={w[-k:]}" for k in (3, 4, 5) if n >= k), f"h={shape}",
    )]


def slots(names: list[bytes]) -> list[int]:
    import xxhash

    return [xxhash.xxh3_64_intdigest(x) % DIMENSIONS for x in names]


def _products(m: np.ndarray, v0: np.ndarray) -> np.ndarray:
    """Row vectors v_t = v_{t-1} m_t, each scaled to sum 1, for m of shape (n, 2, 2).

    The chain is cut into runs that are walked in step: first for their products,
    then, from the vectors these give at the runs' begins, for the vectors themselves.
    """
    n = len(m)
    run = max(1, int(np.sqrt(n)))
    rows = -(-n // run)
    if rows * run > n:
        m = np.concatenate([m, np.broadcast_to(np.eye(2), (rows * run - n, 2, 2))])
    a, b, c, d = (np.ascontiguousarray(m[:, i, j].reshape(rows, run).T) for i in (0, 1) for j in (0, 1))
    p, q, r, s = np.ones(rows), np.zeros(rows), np.zeros(rows), np.ones(rows)
    for t in range(run):
        p, q, r, s = p * a[t] + q * c[t], p * b[t] + q * d[t], r * a[t] + s * c[t], r * b[t] + s * d[t]
        scale = 1.0 / np.maximum(p + q + r + s, 1e-300)
        p, q, r, s = p * scale, q * scale, r * scale, s * scale
    x, y = float(v0[0]), float(v0[1])
    begin = np.empty((rows, 2))
    for i, (pi, qi, ri, si) in enumerate(zip(p.tolist(), q.tolist(), r.tolist(), s.tolist())):
        begin[i] = x, y
        x, y = x * pi + y * ri, x * qi + y * si
        total = x + y
        x, y = x / total, y / total
    out = np.empty((run, rows, 2))
    x, y = begin[:, 0].copy(), begin[:, 1].copy()
    for t in range(run):
        x, y = x * a[t] + y * c[t], x * b[t] + y * d[t]
        scale = 1.0 / (x + y)
        x, y = x * scale, y * scale
        out[t, :, 0], out[t, :, 1] = x, y
    return out.transpose(1, 0, 2).reshape(-1, 2)[:n]


@dataclass
class Chain:
    """Transition potentials: the log weight of plain-toxic, toxic-plain and toxic-toxic against plain-plain, and of starting toxic."""

    to: float = -2.0
    back: float = 0.0
    stay: float = 0.0
    start: float = -2.0

    def messages(self, emission: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Marginals of toxic, of the pairs with the word before (n, 2, 2), and log P(plain | all plain before), P(first word toxic | text)."""
        e = np.exp(np.clip(emission, -30, 30))
        move = np.exp(np.array([[0.0, self.to], [self.back, self.stay]]))
        m = np.broadcast_to(move, (len(e), 2, 2)).copy()
        m[first] = np.exp([0.0, self.start])
        m[:, :, 1] *= e[:, None]
        ahead = _products(m, np.array([0.5, 0.5]))
        # Backward: b_{t-1} = m_t b_t, as row vectors over the turned-round chain.
        turned = m[:0:-1].transpose(0, 2, 1)
        behind = np.full((len(e), 2), 0.5)
        if len(e) > 1:
            behind[-2::-1] = _products(np.ascontiguousarray(turned), np.array([0.5, 0.5]))
        both = ahead * behind
        toxic = both[:, 1] / both.sum(axis=1)
        before = np.concatenate([[[0.5, 0.5]], ahead[:-1]])
        pairs = before[:, :, None] * m * behind[:, None, :]
        pairs /= pairs.sum(axis=(1, 2), keepdims=True)
        stay = m[:, 0, 0] * behind[:, 0]
        plain = np.log(stay / (stay + m[:, 0, 1] * behind[:, 1]))
        return toxic, pairs, plain, toxic[first]


class Words:
    """Word numbers and, for each, its potential as word, left and right neighbour. Forgets beyond a bound."""

    def __init__(self, weights: np.ndarray, bound: int = 400_000):
        self.weights, self.bound = weights, bound
        self.index: dict[bytes, int] = {}
        self.scores = np.zeros((0, 3))

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self.index) > self.bound:
            self.index, self.scores = {}, np.zeros((0, 3))
        new = list(set(words).difference(self.index))
        if new:
            n = len(self.index)
            self.index.update(zip(new, range(n, n + len(new))))
            ids, sizes = [], []
            for w in new:
                own = slots(features(w))
                ids += own
                sizes.append(len(own))
            own = np.add.reduceat(self.weights[np.array(ids)], np.concatenate([[0], np.cumsum(sizes)[:-1]]))
            near = self.weights[np.array([slots([b"l=" + w, b"r=" + w]) for w in new])]
            self.scores = np.concatenate([self.scores, np.column_stack([own, near])])
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))


def emissions(scores: np.ndarray, at: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Potentials of a stream of word numbers; neighbours do not reach over the begin of a text."""
    e = scores[at, 0].copy()
    if len(at) > 1:
        inner = ~first[1:]
        e[1:][inner] += scores[at[:-1], 1][inner]
        e[:-1][inner] += scores[at[1:], 2][inner]
    return e


@dataclass
class Model:
    weights: np.ndarray
    chain: Chain
    calibration: np.ndarray  # of 1, log odds of any toxic word, log odds of the likeliest one

    def marginals(self, texts: list[str], words: Words) -> tuple[list[np.ndarray], np.ndarray]:
        """Each text's marginals by word, and the documents' inputs to the calibration."""
        cut = [content_words(t) for t in texts]
        sizes = np.array([len(c) for c in cut], np.int64)
        inputs = np.tile([1.0, _NEUTRAL, _NEUTRAL], (len(texts), 1))
        if not sizes.sum():
            return [np.zeros(0) for _ in cut], inputs
        at = words([w for c in cut for w in c])
        full = np.flatnonzero(sizes)
        begin = (np.cumsum(sizes) - sizes)[full]
        first = np.zeros(len(at), bool)
        first[begin] = True
        toxic, _, plain, _ = self.chain.messages(emissions(words.scores, at, first), first)
        none = np.add.reduceat(plain, begin)
        some = np.log(np.clip(-np.expm1(none), 1e-12, None)) - none
        most = np.maximum.reduceat(toxic, begin)
        inputs[full, 1] = np.clip(some, _NEUTRAL, -_NEUTRAL)
        inputs[full, 2] = np.clip(np.log(np.maximum(most, 1e-12)) - np.log(np.maximum(1 - most, 1e-12)), _NEUTRAL, -_NEUTRAL)
        return np.split(toxic, np.cumsum(sizes)[:-1]), inputs

    def scores(self, inputs: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-inputs @ self.calibration))


def _units(words: set[bytes]) -> set[str]:
    out = set()
    for w in words:
        s = w.decode("utf-8", "replace")
        out.add(s)
        out |= {s[:k] + "*" for k in (4, 5, 6) if len(s) > k}
    return out


def _group(words: list[bytes]) -> int:
    """The smallest hash of a text's runs of five words: near copies mostly share it and so count once."""
    grams = gram_hashes(hash_words(words), min(5, len(words))) if words else np.zeros(0, np.uint64)
    return int(grams.min()) if len(grams) else 0


def offending_units(docs: list[tuple[list[bytes], int]], plain_weight: float, precision: float = 0.95) -> list[str]:
    """Words and beginnings (with *) that explain toxic documents.

    First those that explain most documents not yet explained, one after another; then other words that
    hardly occur elsewhere and are frequent, or begin like one already found.
    """
    where: dict[str, set[int]] = defaultdict(set)
    others: dict[str, set[int]] = defaultdict(set)
    groups = {_group(words): (words, toxic) for words, toxic in docs}
    toxic = sum(t for _, t in groups.values())
    least = 4 if toxic >= 150 else 3
    # Most units occur once: their hashes are counted before any unit is kept.
    slot = lambda u: zlib.crc32(u.encode()) & 0x3FFFFF
    often = np.zeros(1 << 22, np.uint8)
    for words, t in groups.values():
        if t:
            at = np.unique(np.array([slot(u) for u in _units(set(words))], np.int64))
            often[at] = np.minimum(often[at], 254) + 1
    for i, (words, t) in groups.items():
        for u in _units(set(words)) if t else ():
            if often[slot(u)] > 1:
                where[u].add(i)
    where = {u: x for u, x in where.items() if len(x) >= 2}
    for i, (words, t) in groups.items():
        for u in _units(set(words)) if not t else ():
            if u in where:
                others[u].add(i)
    sure = {u: x for u, x in where.items() if len(x) >= precision * (len(x) + plain_weight * len(others[u]))}
    pool = {u: x for u, x in sure.items() if len(x) >= least}
    chosen, left = [], set().union(*pool.values()) if pool else set()
    while pool:
        u = max(pool, key=lambda u: (len(pool[u] & left), len(u), u))
        gain = pool[u] & left
        if len(gain) < least:
            break
        chosen.append(u)
        left -= gain
        pool = {v: x for v, x in pool.items() if len(x & left) >= least}
    begins = {u[:5] for u in chosen if u[-1] != "*" and len(u) > 5}
    more = [u for u, x in sure.items() if u[-1] != "*" and (len(x) >= 2 * least or u[:5] in begins)]
    return chosen + sorted(set(more) - set(chosen))


def _matches(word: bytes, whole: set[str], begins: tuple[str, ...]) -> bool:
    s = word.decode("utf-8", "replace")
    return s in whole or bool(begins) and s.startswith(begins)


def _adam(gradient, x: np.ndarray, steps: int, rate: float) -> np.ndarray:
    m, v = np.zeros_like(x), np.zeros_like(x)
    for t in range(1, steps + 1):
        g = gradient(x)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return x


def fit(sample: list[tuple[str, int]], plain_weight: float = 1.0, steps: int = 80, seed: int = 7) -> Model:
    """A model of (text, toxic) pairs. plain_weight: how many plain documents each sampled one stands for, against toxic ones.

    With labels of one kind only, or none, the score is the share of toxic labels.
    """
    pairs = sorted({(t or "", int(y)) for t, y in sample})
    toxic_share = (sum(y for _, y in pairs) + 0.5) / (sum(y + (1 - y) * plain_weight for _, y in pairs) + 1.0)
    flat = Model(np.zeros(DIMENSIONS), Chain(), np.array([np.log(toxic_share / (1 - toxic_share)) if toxic_share < 1 else 5.0, 0.0, 0.0]))
    if len({y for _, y in pairs}) < 2:
        return flat
    cut = [(content_words(t), y) for t, y in pairs]
    units = offending_units(cut, plain_weight)
    if not units:
        return flat
    whole, begins = {u for u in units if u[-1] != "*"}, tuple(u[:-1] for u in units if u[-1] == "*")
    known: dict[bytes, bool] = {}
    rng = np.random.default_rng(seed)
    windows: list[tuple[list[bytes], list[bool]]] = []
    for words, y in cut:
        tags = [known[w] if w in known else known.setdefault(w, _matches(w, whole, begins)) for w in words]
        marked = [i for i, x in enumerate(tags) if x] if y else []
        spots = {max(0, i - 8) for i in marked[:8]} | ({int(rng.integers(0, max(1, len(words) - 16)))for _ in range(1 + len(words) // 200)} if not y else set())
        windows += [(words[i : i + 17], tags[i : i + 17]) for i in sorted(spots) if words]
    first = np.zeros(sum(len(w) for w, _ in windows), bool)
    first[np.cumsum([0, *(len(w) for w, _ in windows[:-1])])] = True
    stream, gold = [w for ws, _ in windows for w in ws], np.array([x for _, ts in windows for x in ts], float)
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(stream))}
    at = np.array([vocabulary[w] for w in stream])
    own = [slots(features(w)) for w in vocabulary]
    owner, own = np.repeat(np.arange(len(own)), [len(x) for x in own]), np.array([i for x in own for i in x])
    near = np.array([slots([b"l=" + w, b"r=" + w]) for w in vocabulary])
    inner = np.flatnonzero(~first)  # words with a left neighbour
    gold_before = gold[inner - 1]

    def spread(by_token: np.ndarray) -> np.ndarray:
        """Sums over features of values by token."""
        n = len(vocabulary)
        out = np.bincount(own, weights=np.bincount(at, weights=by_token, minlength=n)[owner], minlength=DIMENSIONS)
        out += np.bincount(near[:, 0], weights=np.bincount(at[inner - 1], weights=by_token[inner], minlength=n), minlength=DIMENSIONS)
        return out + np.bincount(near[:, 1], weights=np.bincount(at[inner], weights=by_token[inner - 1], minlength=n), minlength=DIMENSIONS)

    def moves(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.array([((1 - a) * b).sum(), (a * (1 - b)).sum(), (a * b).sum()])

    def gradient(x: np.ndarray) -> np.ndarray:
        weights, chain = x[:DIMENSIONS], Chain(*x[DIMENSIONS:])
        scores = np.column_stack([np.bincount(owner, weights=weights[own], minlength=len(vocabulary)), weights[near]])
        toxic, both, _, begin = chain.messages(emissions(scores, at, first), first)
        g = spread(toxic - gold)
        p = both[inner].sum(axis=0)
        t = np.array([p[0, 1], p[1, 0], p[1, 1]]) - moves(gold_before, gold[inner])
        return np.concatenate([g, t, [begin.sum() - gold[first].sum()]]) / len(gold) * 50 + 0.002 * x

    x = _adam(gradient, np.concatenate([np.zeros(DIMENSIONS), [-2.0, 0.0, 0.0, -2.0]]), steps, 0.2)
    model = Model(x[:DIMENSIONS], Chain(*x[DIMENSIONS:]), np.array([0.0, 1.0, 0.0]))
    words, inputs = Words(model.weights), []
    for i in range(0, len(pairs), 500):
        inputs.append(model.marginals([t for t, _ in pairs[i : i + 500]], words)[1])
    z, y = np.concatenate(inputs), np.array([y for _, y in pairs], float)
    w = np.where(y > 0, 1.0, plain_weight)

    c, ridge = np.array([np.log(toxic_share / (1 - toxic_share)), 0.3, 0.3]), np.diag([0.0, 1e-6, 1e-6])
    for _ in range(30):  # Newton's steps of a logistic regression, halved where they go far
        q = 1 / (1 + np.exp(-np.clip(z @ c, -30, 30)))
        slope = z.T @ (w * (q - y)) / w.sum() + ridge @ c
        curve = (z.T * (w * q * (1 - q))) @ z / w.sum() + ridge + 1e-9 * np.eye(3)
        step = np.linalg.solve(curve, slope)
        c = c - step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-9))
    model.calibration = c
    return model


def sample_of(docs: DataFrame, labels: DataFrame, held_out: tuple[int, int] | None) -> tuple[list[tuple[str, int]], float]:
    """Labelled texts outside the held-out part, at most TOXIC_SAMPLE and PLAIN_SAMPLE of them, and the weight of a plain one.

    Which ones is decided by a hash of the id. Documents beyond SAMPLE_CHARS are scored but not learnt from.
    """
    marked = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("toxic is not null and doc_id is not null")
    if held_out:
        marked = marked.where(crc32_of_id() % held_out[0] != held_out[1])
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    totals = {r[0]: r[1] for r in marked.groupBy((F.col("toxic") > 0).alias("t")).count().collect()}
    order = F.xxhash64(F.col("doc_id").cast("string"))
    picked = marked.where("toxic > 0").orderBy(order, "doc_id").limit(TOXIC_SAMPLE).unionByName(marked.where("toxic = 0").orderBy(order, "doc_id").limit(PLAIN_SAMPLE))
    # At most TOXIC_SAMPLE + PLAIN_SAMPLE ids.
    rows = docs.select("doc_id", "text").where(F.length("text") <= SAMPLE_CHARS).join(F.broadcast(picked), "doc_id").select("text", "toxic")
    rows = rows.groupBy("text").agg(F.max("toxic").alias("toxic")).limit(TOXIC_SAMPLE + PLAIN_SAMPLE).collect()
    share = lambda kind, most: totals.get(kind, 0) / max(1, min(totals.get(kind, 0), most))
    return [(r[0], min(1, r[1])) for r in rows], share(False, PLAIN_SAMPLE) / share(True, TOXIC_SAMPLE) if totals.get(True) else 1.0


def train(docs: DataFrame, labels: DataFrame, held_out: tuple[int, int] | None = (4, 2)) -> Model:
    sample, weight = sample_of(docs, labels, held_out)
    return fit(sample, weight)


_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
assert all((WORD_TABLE[b] == 32) == (_WORD.match(chr(b)) is None) for b in range(128))


def spans_of(text: str, marginals: np.ndarray, least: float = 0.5) -> list[dict]:
    """Runs of toxic words: begin and end in characters, and the largest marginal."""
    if not len(marginals) or marginals.max() < least:
        return []
    out: list[dict] = []
    last = -2
    for i, m in enumerate(_WORD.finditer(text)):
        if marginals[i] >= least:
            if i == last + 1:
                out[-1] |= {"end": m.end(), "p": max(out[-1]["p"], float(marginals[i]))}
            else:
                out.append({"begin": m.start(), "end": m.end(), "p": float(marginals[i])})
            last = i
    return out


def tag_documents(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of docs: doc_id, score, spans (begin, end, p). Null and empty texts have no spans and a low score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by DIMENSIONS
    out = schema(("doc_id", id_type(docs)), ("score", "double"), ("spans", "array<struct<begin:int,end:int,p:double>>"))

    def tag(batches):
        words = Words(shared.value.weights)
        for batch in batches:
            for part in slices(batch, 1, 1 << 20, 500):
                text = [t or "" for t in part.column(1).to_pylist()]
                marginals, inputs = shared.value.marginals(text, words)
                yield batch_of(out, [part.column(0), shared.value.scores(inputs), [spans_of(t, m) for t, m in zip(text, marginals)]])

    return map_batches(docs.select("doc_id", "text"), tag, out)


def score_documents(docs: DataFrame, labels: DataFrame, held_out: tuple[int, int] = (4, 2), threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted, n_spans. Labels only serve to fit the model.

    Null and empty texts have no spans and the score of a text without toxic words; repeated rows are scored each. Where the labels to learn
    from lack toxic or plain documents, all scores are equal. Columns besides those named are ignored; an empty table gives no rows.
    """
    tagged = tag_documents(docs, train(docs, labels, held_out))
    return tagged.select(
        "doc_id", (crc32_of_id() % held_out[0] == held_out[1]).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"), F.size("spans").alias("n_spans"),
    )


def without_toxic(docs: DataFrame, labels: DataFrame, held_out: tuple[int, int] = (4, 2), threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, with all their columns; repeated rows are judged each.

    Null and empty texts are judged as texts without toxic words. Where the labels to learn from
    lack toxic or plain documents, nothing tells them apart and all documents stay.
    """
    sample, weight = sample_of(docs, labels, held_out)
    if len({toxic for _, toxic in sample}) < 2:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(fit(sample, weight))
    at = docs.columns.index("text")

    def keep(batches):
        words = Words(shared.value.weights)
        for batch in batches:
            for part in slices(batch, at, 1 << 20, 500):
                _, inputs = shared.value.marginals([t or "" for t in part.column(at).to_pylist()], words)
                yield part.filter(pa.array(shared.value.scores(inputs) < threshold))

    return map_batches(docs, keep, T.StructType(docs.schema.fields))
