"""Operator 10: toxicity by a linear-chain conditional random field over the words of a sentence.

Learning. From the labelled rows (never the held-out fifth) a bounded sample is taken: up to ``ROWS`` rows of
either label, by the hash of doc_id, of at most ``CHARS`` characters. Labels are per document, so tokens are
labelled first: a word, or a word's start or end of four or five letters, that is far more common in toxic
texts of the sample is evidence, and the words of toxic texts that show evidence are the labelled toxic tokens. On
those tokens a binary CRF is fitted (features of the word and of both neighbours, hashed; transitions), by
exact gradients from forward-backward. Document scores are a logistic function of the two strongest
marginals, fitted on the same sample.

Scoring. Each sentence, whatever its length, is run forward and
backward; the marginals give the offending spans (code points, end exclusive) and the document's score. All
texts are scored whole, streamed by batches; the sample is all that one task holds, and the model (a table of fixed
size) is broadcast.

Defined cases: null and empty texts and texts without words score as no toxic token; without labels of both
kinds every score is 0 (or 1, if only toxic ones exist); labels that are null are left out; repeated rows
score alike; rows with a null id are never held out; lang, source and doc_id are never inputs of a score.
"""

from __future__ import annotations

import pickle
import re
from array import array
from collections.abc import Iterator
from itertools import islice
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free, small_batches, whole_text

ROWS, CHARS = 3000, 20_000
BUCKETS, KEPT = 1 << 20, 300_000
#: Tokens of sentences that are run together, with their padding.
AREA = 1 << 19
TOKEN = re.compile(r"\w+|[.!?\n]")
#: The first entries of every vocabulary; they end a sentence.
STOPS = (".", "!", "?", "\n")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _parts(word: str) -> list[str]:
    out = ["=" + word]
    for n in (4, 5):
        if len(word) > n:
            out += [f"^{word[:n]}", f"{word[-n:]}$"]
    return out


def _features(word: str) -> tuple[int, ...]:
    """Hashed features: of the word (five; BUCKETS for none), of it as the word before and as the one after."""
    whole, none = word.encode("utf-8", "surrogatepass"), BUCKETS
    ends = [none] * 4
    for i, n in enumerate((4, 5)):
        if len(word) > n:
            ends[i] = crc32(word[:n].encode("utf-8", "surrogatepass"), n) % BUCKETS
            ends[i + 2] = crc32(word[-n:].encode("utf-8", "surrogatepass"), n + 8) % BUCKETS
    return crc32(whole) % BUCKETS, *ends, crc32(whole, 20) % BUCKETS, crc32(whole, 21) % BUCKETS


def _pieces(numbers: np.ndarray) -> np.ndarray:
    """Number of the sentence of each token; -1 for a stop."""
    stop = numbers < len(STOPS)
    return np.where(stop, -1, np.cumsum(stop))


def _padded(piece: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Token places of sentences of like length as a matrix, and where it holds a token."""
    place = np.flatnonzero(piece >= 0)
    if not len(place):
        return
    p = piece[place]
    first = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
    length = np.diff(np.r_[first, len(p)])
    order = np.argsort(length, kind="stable")
    at = 0
    while at < len(order):
        ahead = length[order[at:]]
        some = order[at : at + max(1, int(np.searchsorted(ahead * np.arange(1, len(ahead) + 1), AREA, side="right")))]
        at += len(some)
        n = length[some]
        t = np.arange(n[-1])
        there = t < n[:, None]
        yield place[np.minimum(first[some][:, None] + t, len(p) - 1)], there


def _forward_backward(e: np.ndarray, there: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of the forward and the backward messages; trans: weights of 0-1, 1-0 and 1-1."""
    t01, t10, t11 = trans
    f, b = np.zeros_like(e), np.zeros_like(e)
    f[:, 0] = e[:, 0]
    for t in range(1, e.shape[1]):
        r = f[:, t - 1]
        f[:, t] = np.clip(e[:, t] + np.logaddexp(r + t11, t01) - np.logaddexp(r + t10, 0), -40, 40)
    for t in range(e.shape[1] - 2, -1, -1):
        r = e[:, t + 1] + b[:, t + 1]
        b[:, t] = np.where(there[:, t + 1], np.logaddexp(r + t11, t10) - np.logaddexp(r + t01, 0), 0)
    return f, b


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Vocabulary(dict):
    """Numbers of words, stops first."""

    def __init__(self) -> None:
        super().__init__({w: i for i, w in enumerate(STOPS)})

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n

    def numbers(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


class Model:
    """weights: of the hashed features; bias; trans; head: logistic weights of the document score; const: the
    score of every text where nothing could be learnt."""

    def __init__(self, weights: np.ndarray, bias: float, trans: np.ndarray, head: np.ndarray, const: float | None) -> None:
        self.weights, self.bias, self.trans, self.head, self.const = weights, bias, trans, head, const
        self._forget()

    def numbers(self) -> tuple:
        return self.weights, self.bias, self.trans, self.head, self.const

    def _forget(self) -> None:
        self.known, self.names, self.values = Vocabulary(), 0, np.zeros((4096, 3), np.float32)

    def _emissions(self, numbers: np.ndarray, piece: np.ndarray) -> np.ndarray:
        if len(self.known) > self.names:
            while len(self.known) > len(self.values):
                self.values = np.concatenate([self.values, np.zeros_like(self.values)])
            new = np.array([_features(w) for w in islice(self.known, self.names, None)])
            v = self.weights[new]
            self.values[self.names : len(self.known)] = np.c_[v[:, :-2].sum(1), v[:, -2:]]
            self.names = len(self.known)
        v = self.values[numbers]
        e = v[:, 0] + np.float32(self.bias)
        beside = (piece[1:] == piece[:-1]) & (piece[1:] >= 0)
        e[1:] += np.where(beside, v[:-1, 1], 0)
        e[:-1] += np.where(beside, v[1:, 2], 0)
        return e.astype(np.float64)

    def marginals(self, texts: list[str]) -> list[np.ndarray]:
        """For each text, the probability of being toxic of each of its tokens."""
        if len(self.known) > KEPT:
            self._forget()
        words: list[str] = []
        ends = []
        for text in texts:
            words += tokens(text)
            words.append("\n")
            ends.append(len(words))
        numbers = self.known.numbers(words)
        piece = _pieces(numbers)
        e, p = self._emissions(numbers, piece), np.zeros(len(words))
        for places, there in _padded(piece):
            f, b = _forward_backward(e[places], there, self.trans)
            p[places[there]] = _sigmoid(f + b)[there]
        return [x[:-1] for x in np.split(p, ends[:-1])]

    def score(self, p: np.ndarray) -> float:
        if self.const is not None:
            return self.const
        return float(_sigmoid(_summary(p) @ self.head))


def _together(texts: list[str], chars: int = 500_000) -> Iterator[list[str]]:
    """Runs of texts of about so many characters."""
    some: list[str] = []
    size = 0
    for t in texts:
        some.append(t)
        size += len(t)
        if size >= chars:
            yield some
            some, size = [], 0
    if some:
        yield some


def _summary(p: np.ndarray) -> np.ndarray:
    """One, and the log-odds of the two strongest marginals."""
    top = np.zeros(2)
    strongest = np.sort(np.partition(p, -2)[-2:] if len(p) > 2 else p)[::-1]
    top[: len(strongest)] = strongest
    top = np.clip(top, 1e-3, 1 - 1e-3)
    return np.concatenate([[1.0], np.log(top / (1 - top))])


def lowered(text: str) -> str:
    """text in lower case, character by character where that would change its length: offsets stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) > 1 else c.lower() for c in text)


def tokens(text: str) -> list[str]:
    return TOKEN.findall(lowered(text))


def _evidence(sentences: dict[bytes, bool], words: list[str]) -> np.ndarray:
    """For every word of the vocabulary, whether a part of it is evidence: toxic sentences have it at least ten
    times as often as others, by more than chance (the Chernoff bound on such a share is below e^-14).
    Sentences count once, however many texts repeat them."""
    parts = Vocabulary()
    of_word = [[parts[p] for p in _parts(w)] for w in words]
    seen = np.zeros((2, len(parts)), np.int64)
    held: tuple[array, array] = (array("i"), array("i"))
    for key, y in sentences.items():
        held[y].extend({p for n in set(np.frombuffer(key, np.int32).tolist()) for p in of_word[n]})
        if len(held[y]) > 1_000_000:
            seen[int(y)] += np.bincount(held[y], minlength=len(parts))
            del held[y][:]
    for y in (0, 1):
        seen[y] += np.bincount(np.array(held[y], np.int64), minlength=len(parts))
    n1 = sum(sentences.values())
    n0 = len(sentences) - n1
    if not n1 or not n0:
        return np.zeros(len(words), bool)
    base, k = n1 / (n1 + n0), seen.sum(0)
    share = seen[1] / np.maximum(k, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        up = np.where(share > 0, share * np.log(share / base), 0)
        down = np.where(share < 1, (1 - share) * np.log((1 - share) / (1 - base)), 0)
    good = (seen[1] / n1 >= 10 * seen[0] / n0) & (share > base) & (k * (up + down) >= 14)
    return np.array([any(good[p] for p in ps) for ps in of_word], bool)


def fit(texts: list[str], labels: list[int], rounds: int = 30, l2: float = 1e-3) -> Model:
    """The model of labelled texts. Sentences are held as the numbers of their words."""
    toxic = np.array(labels, bool)
    if not toxic.any() or toxic.all():
        return Model(np.zeros(BUCKETS + 1, np.float32), 0.0, np.zeros(3), np.zeros(3), float(toxic.any()))
    vocabulary, rng = Vocabulary(), np.random.default_rng(7)
    of: dict[bytes, bool] = {}
    for text, y in zip(texts, toxic, strict=True):
        numbers = vocabulary.numbers(tokens(text)).astype(np.int32)
        piece = _pieces(numbers)
        place = np.flatnonzero(piece >= 0)
        for at in np.split(place, np.flatnonzero(np.diff(piece[place])) + 1) if len(place) else []:
            key = numbers[at[0] : at[-1] + 1].tobytes()
            of[key] = of.get(key, True) and bool(y)
    shows = _evidence(of, list(vocabulary))
    runs: list[np.ndarray] = []
    tags: list[np.ndarray] = []
    for key, y in of.items():
        own = np.frombuffer(key, np.int32)
        marks = shows[own] if y else np.zeros(len(own), bool)
        if marks.any() or rng.random() < min(1.0, 30_000 / len(of)):
            runs += [own, np.array([3], np.int32)]  # 3: the line end
            tags += [marks, np.array([False])]
    del of
    numbers, y = np.concatenate(runs).astype(np.int64), np.concatenate(tags).astype(float)
    piece = _pieces(numbers)
    feats = np.array([_features(w) for w in vocabulary])
    own = feats[numbers, :-2].ravel()
    own_at = np.repeat(np.arange(len(numbers)), feats.shape[1] - 2)
    beside = np.flatnonzero((piece[1:] == piece[:-1]) & (piece[1:] >= 0))
    prev = feats[numbers[beside], -2]
    nxt = feats[numbers[beside + 1], -1]
    weights, bias, trans = np.zeros(BUCKETS + 1), -3.0, np.zeros(3)
    g2_w, g2_t, g2_b = np.full(BUCKETS + 1, 1e-2), np.full(3, 1.0), 1.0
    blocks = list(_padded(piece))
    for _ in range(rounds):
        e = bias + np.bincount(own_at, weights[own], len(numbers))
        e[beside + 1] += weights[prev]
        e[beside] += weights[nxt]
        p, gt = np.zeros(len(numbers)), np.zeros(3)
        for places, there in blocks:
            f, b = _forward_backward(e[places], there, trans)
            p[places[there]] = _sigmoid(f + b)[there]
            both = there[:, 1:]
            left, right = f[:, :-1], e[places][:, 1:] + b[:, 1:]
            logs = np.stack([np.zeros_like(left), right + trans[0], left + trans[1], left + right + trans[2]])
            q = np.exp(logs - logs.max(0))
            q = (q / q.sum(0))[:, both]
            y0, y1 = y[places][:, :-1][both], y[places][:, 1:][both]
            gt += [(q[1] - (1 - y0) * y1).sum(), (q[2] - y0 * (1 - y1)).sum(), (q[3] - y0 * y1).sum()]
        d = np.where(piece >= 0, p - y, 0)
        gw = sum(np.bincount(i, d[at], BUCKETS + 1) for i, at in ((own, own_at), (prev, beside + 1), (nxt, beside)))
        gw += l2 * weights
        gw[BUCKETS] = 0.0  # no feature
        g2_w += gw**2
        g2_t += gt**2
        g2_b += d.sum() ** 2
        weights -= 1.0 * gw / np.sqrt(g2_w)
        trans -= 0.3 * gt / np.sqrt(g2_t)
        bias -= 0.3 * d.sum() / np.sqrt(g2_b)
    model = Model(weights.astype(np.float32), float(bias), trans, np.zeros(3), None)
    x = np.array([_summary(p) for some in _together(texts) for p in model.marginals(some)])
    model._forget()
    head = np.zeros(3)
    balance = np.where(toxic, 0.5 / toxic.mean(), 0.5 / (~toxic).mean())
    for _ in range(30):  # Newton steps, ridge 1
        q = _sigmoid(x @ head)
        h = (x * (balance * q * (1 - q))[:, None]).T @ x + np.eye(3)
        head -= np.linalg.solve(h, x.T @ (balance * (q - toxic)) + head)
    model.head = head
    return model


def _fit_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parts = list(batches)
    sample = pd.concat(parts) if parts else pd.DataFrame({"doc_id": [], "text": [], "toxic": []})
    sample = sample.sort_values(["doc_id", "text"]).drop_duplicates("text")
    model = fit(sample.text.tolist(), sample.toxic.tolist())
    yield pd.DataFrame({"model": [pickle.dumps(model.numbers())]})


def learn(docs: DataFrame, labels: DataFrame, rows: int = ROWS, chars: int = CHARS) -> Model:
    """fit() on the bounded sample of labelled rows that are not held out, in one task."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).dropna().filter(~held_out(F.col("doc_id")))
    mix = F.xxhash64(F.lit("crf"), "doc_id")
    parts = [known.filter(F.col("toxic") == y).orderBy(mix, "doc_id").limit(rows) for y in (0, 1)]
    chosen = {r["doc_id"]: r["toxic"] for part in parts for r in part.collect()}  # 2 * rows at most
    if not chosen:
        return fit([], [])
    ids = docs.sparkSession.createDataFrame(list(chosen.items()), "doc_id bigint, toxic int")
    sample = (
        docs.select("doc_id", whole_text().alias("text")).filter(F.length("text") <= chars)
        .join(F.broadcast(ids), "doc_id").orderBy("doc_id", "text").limit(2 * rows)
    )
    made = sample.repartition(1).mapInPandas(_fit_rows, "model binary").collect()
    return Model(*pickle.loads(made[0]["model"])) if made else fit([], [])


def _score_batches(sent):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = Model(*sent.value)
        for texts in batches:
            scores, spans = [], []
            for some in _together(list(texts)):
                for text, p in zip(some, model.marginals(some), strict=True):
                    scores.append(model.score(p))
                    bad = np.flatnonzero(p >= 0.5)
                    found = ""
                    if len(bad):
                        at = [m.span() for m in TOKEN.finditer(lowered(text))]
                        runs = np.split(bad, np.flatnonzero(np.diff(bad) > 1) + 1)
                        found = ",".join(f"{at[r[0]][0]}:{at[r[-1]][1]}" for r in runs)
                    spans.append(found)
            yield pd.DataFrame({"score": scores, "spans": spans})

    return run


def scored(docs: DataFrame, model: Model, into: str) -> DataFrame:
    """docs with column ``into``: struct of score and spans (start:end, comma-joined)."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model.numbers())
    udf = F.pandas_udf(_score_batches(sent), "score double, spans string")
    return docs.withColumn(into, udf(whole_text()))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, spans for every row of docs."""
    out = scored(docs.select("doc_id", "text"), learn(docs, labels), "tox")
    return out.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("tox.score").alias("score"),
        (F.col("tox.score") >= 0.5).cast("int").alias("predicted"),
        F.col("tox.spans").alias("spans"),
    )


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those predicted toxic; columns as in docs."""
    (tox,) = free(docs, "tox")
    return scored(docs, learn(docs, labels), tox).filter(F.col(f"{tox}.score") < 0.5).select(*docs.columns)
