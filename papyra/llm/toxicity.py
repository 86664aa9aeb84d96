"""Toxic spans by a linear-chain conditional random field.

Labels mark whole documents, so token labels are derived first: features (a word, its
beginnings) that toxic documents hold far more often than others make a token toxic where
the document is.  A two-state chain over hashed features learns from these sequences by
gradient ascent on their likelihood; beginnings of words let it tag forms it never met.
Training is piecewise, on parts of 64 words, in one task of an executor; the driver sees
only the model.

In scoring a document is one chain, however long.  It lies in rows of 64 words; a row's
effect on the messages that pass through it is a 2 x 2 matrix, so all rows of a batch are
multiplied out at once, a short scan over each document's rows gives every row its
incoming messages, and forward-backward then runs in all rows together.  The marginals
give the offending offsets, and their sum and maximum, by a small calibrated regression,
the document's score.
"""

from __future__ import annotations

import pickle
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_lengths, hash_sample, mix64, slices, table, word_hashes

CHAIN = 64
BITS = 22
#: The bound of the training sample: documents of either label, and bytes of one text.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_BYTES = 1500, 2500, 30_000
THRESHOLD = 0.3
_SPLIT = re.compile(r"[\W_]+")
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def features(word: str) -> list[int]:
    """Hashed features of one lower-case word: itself and its beginnings of 3 to 8 letters."""
    found = [zlib.crc32(b"w=" + word.encode())]
    found += [zlib.crc32(b"p%d=" % n + word[:n].encode()) for n in range(3, min(8, len(word) - 1) + 1)]
    return [x & ((1 << BITS) - 1) for x in found]


def parts(token: bytes) -> list[str]:
    """The lower-case words of a token between blanks, without punctuation."""
    return [w for w in _SPLIT.split(token.decode("utf-8", "replace").lower()) if w]


@dataclass
class Model:
    weights: np.ndarray  # by feature: toxic against clean
    bias: float
    moves: np.ndarray  # 2 x 2 scores, from, to
    calibration: np.ndarray  # of 1, log(1 + expected toxic tokens), largest log odds
    prior: float

    def packed(self) -> bytes:
        """The model without the weights that are zero, which are nearly all."""
        at = np.flatnonzero(self.weights).astype(np.int32)
        return pickle.dumps((at, self.weights[at], self.bias, self.moves, self.calibration, self.prior))

    @classmethod
    def unpacked(cls, data: bytes) -> "Model":
        at, some, *rest = pickle.loads(data)
        weights = np.zeros(1 << BITS, np.float32)
        weights[at] = some
        return cls(weights, *rest)

    def emission(self, token: bytes) -> float:
        """A token's score for toxic: its most toxic word's."""
        return max((self.bias + float(self.weights[features(w)].sum()) for w in parts(token)), default=self.bias)


class Emissions(dict):
    """Token -> emission, for the tokens met so far; bounded."""

    LIMIT = 300_000

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, token: bytes) -> float:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[token] = self.model.emission(token)
        return value


def posteriors(scores: np.ndarray, moves: np.ndarray, ahead_in=None, back_in=None, used=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward over rows of emission scores (toxic against clean).

    Returns marginal log odds and the messages as ratios toxic to clean.  With two states
    the messages are one ratio a step, so a step is a few vector operations for all rows.
    ahead_in, back_in: the messages that come into each row from before (nan: a document
    begins) and from behind; used: which places of a row hold a token (all, by default).
    """
    e, m = np.exp(np.clip(scores, -40, 40)), np.exp(moves)
    ahead, back = np.empty_like(e), np.empty_like(e)
    r = e[:, 0].copy()
    if ahead_in is not None:
        went = e[:, 0] * (ahead_in * m[1, 1] + m[0, 1]) / (ahead_in * m[1, 0] + m[0, 0])
        r = np.where(np.isnan(ahead_in), r, went)
    ahead[:, 0] = r
    for t in range(1, e.shape[1]):
        r = e[:, t] * (r * m[1, 1] + m[0, 1]) / (r * m[1, 0] + m[0, 0])
        ahead[:, t] = r
    b = np.ones(len(e)) if back_in is None else back_in.copy()
    back[:, -1] = b
    for t in range(e.shape[1] - 2, -1, -1):
        x = e[:, t + 1] * b
        went = (m[1, 1] * x + m[1, 0]) / (m[0, 1] * x + m[0, 0])
        b = went if used is None else np.where(used[:, t + 1], went, b)
        back[:, t] = b
    return np.log(ahead * back), ahead, back


def transfers(scores: np.ndarray, moves: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What each row does to a message that passes it forward, and backward: [a, b, c, d] maps x to (a x + b) / (c x + d)."""
    e, m = np.exp(np.clip(scores, -40, 40)), np.exp(moves)
    ahead = np.zeros((4, len(e)))
    ahead[0] = ahead[3] = 1
    back = ahead.copy()
    for t in range(e.shape[1]):
        x = e[:, t]
        a, b, c, d = ahead
        ahead = np.stack((x * (m[1, 1] * a + m[0, 1] * c), x * (m[1, 1] * b + m[0, 1] * d), m[1, 0] * a + m[0, 0] * c, m[1, 0] * b + m[0, 0] * d))
        ahead /= ahead.max(0)
    for t in range(e.shape[1] - 1, -1, -1):
        x = e[:, t]
        a, b, c, d = back
        now = np.stack((m[1, 1] * x * a + m[1, 0] * c, m[1, 1] * x * b + m[1, 0] * d, m[0, 1] * x * a + m[0, 0] * c, m[0, 1] * x * b + m[0, 0] * d))
        back = np.where(used[:, t], now / now.max(0), back)
    return ahead, back


def chains(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(row, column) of every token when documents are cut into rows of 64 tokens, and the number of rows."""
    per = -(-lengths // CHAIN)
    first = np.cumsum(per) - per
    at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return np.repeat(first, lengths) + at // CHAIN, at % CHAIN, int(per.sum())


#: In training, a row's free places behave as surely clean tokens; scoring passes them over.
PAD = -12.0


def distinct(rows: list[tuple[bytes, int]]) -> list[tuple[bytes, int]]:
    """Leaves out rows that nearly copy an earlier one, whose words would count as evidence again and again.

    Copies share one of four pairs of least word hashes, which texts alike by half do half the time.
    """
    met, out = set(), []
    salts = np.random.default_rng(11).integers(1, 1 << 63, 8, dtype=np.uint64) | np.uint64(1)
    for text, y in rows:
        words = text.lower().split()
        if words:
            least = [int((mix64(word_hashes(words) * s)).min()) for s in salts]
            bands = {(i, *least[i : i + 2]) for i in range(0, 8, 2)}
            if bands & met:
                continue
            met |= bands
        out.append((text, y))
    return out


def train(rows: list[tuple[bytes, int]], shares: tuple[float, float]) -> Model:
    """rows: (text, toxic); shares: how much of its class (clean, toxic) a row stands for."""
    n_toxic = sum(y for _, y in rows)
    n_clean = len(rows) - n_toxic
    known: dict[bytes, int] = {}
    docs = []
    for text, _ in rows:
        docs.append(np.array([known.setdefault(t, len(known)) for t in text.split()], np.int32))
    prior = shares[1] * n_toxic / max(shares[0] * n_clean + shares[1] * n_toxic, 1e-9)
    empty = Model(np.zeros(1 << BITS, np.float32), 0.0, np.zeros((2, 2)), np.array([np.log((prior + 1e-6) / (1 - prior + 1e-6)), 0.0, 0.0]), prior)
    if not n_toxic or not n_clean or not known:
        return empty
    # token -> its features, one after another; numbers of features from 0 on
    word_of: dict[tuple, int] = {}
    word, counts, flat_features = np.empty(len(known), np.int32), np.empty(len(known), np.int64), []
    for i, token in enumerate(known):
        words = tuple(parts(token))
        word[i] = word_of.setdefault(words, len(word_of))
        own = sorted({f for w in words for f in features(w)})
        counts[i] = len(own)
        flat_features += own
    place, feature = np.unique(np.array(flat_features, np.int64), return_inverse=True)
    del flat_features, word_of, known
    stops = np.cumsum(counts)
    owner = np.repeat(np.arange(len(counts)), counts)

    def of(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(feature, which of the tokens) of some tokens."""
        which = np.repeat(np.arange(len(tokens)), counts[tokens])
        at = np.arange(len(which)) - np.repeat(np.cumsum(counts[tokens]) - counts[tokens], counts[tokens])
        return feature[(stops - counts)[tokens][which] + at], which

    # in how many documents a feature occurs at all, and in how many with three different words
    seen_in = np.zeros((2, 2, len(place)), np.int64)
    often = []
    for tokens, (_, y) in zip(docs, rows, strict=True):
        first = tokens[np.unique(word[tokens], return_index=True)[1]]
        found, times = np.unique(of(first)[0], return_counts=True)
        often.append(found[times >= 3])
        seen_in[0, int(y), found] += 1
        seen_in[1, int(y), often[-1]] += 1
    # what toxic documents hold far too often to be chance (by the G statistic)
    base = n_toxic / len(rows)
    b, a = seen_in[:, 0], seen_in[:, 1]
    share = a / np.maximum(a + b, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (np.where(a, a * np.log(share / base), 0) + np.where(b, b * np.log((1 - share) / (1 - base)), 0))
    fit = (a >= 3) & (share > 0.85)
    marked = fit & (g > min(1.7 * np.log(len(place)), 0.6 * (g * fit).max()))  # a small sample makes do with less
    hot = np.zeros(len(counts), bool)
    hot[owner[marked[0][feature]]] = True
    lengths = np.array([len(d) for d in docs])
    flat = np.concatenate(docs)
    y_doc = np.array([y for _, y in rows], bool)
    y = np.zeros(len(flat), bool)
    here = np.zeros(len(place), bool)
    for tokens, many, toxic_doc, stop in zip(docs, often, y_doc, np.cumsum(lengths), strict=True):
        if toxic_doc and len(tokens):
            here[many] = marked[1][many]
            fs, which = of(tokens)
            y[stop - len(tokens) : stop] = hot[tokens]
            y[stop - len(tokens) + which[here[fs]]] = True
            here[many] = False
    row, column, n = chains(lengths)
    # every chain with a toxic token, and of the others every third
    some = np.zeros(n, bool)
    some[row[y]] = True
    some |= np.arange(n) % 3 == 0
    keep = some[row]
    row, column, words, y = (np.cumsum(some) - 1)[row[keep]], column[keep], flat[keep], y[keep]
    n = int(some.sum())
    truth = np.zeros((n, CHAIN), bool)
    truth[row, column] = y
    w, bias, moves = np.zeros(len(place)), -2.0, np.zeros((2, 2))
    square, square_m, square_b = np.full(len(place), 1e-3), np.full((2, 2), 1e-3), 1e-3
    total = len(words)
    true_moves = np.array([[(~truth[:, :-1] & ~truth[:, 1:]).sum(), (~truth[:, :-1] & truth[:, 1:]).sum()], [(truth[:, :-1] & ~truth[:, 1:]).sum(), (truth[:, :-1] & truth[:, 1:]).sum()]])
    for _ in range(60):
        by_word = np.bincount(owner, w[feature], len(counts)) + bias
        scores = np.full((n, CHAIN), PAD)
        scores[row, column] = by_word[words]
        odds, ahead, back = posteriors(scores, moves)
        p = 1 / (1 + np.exp(-odds[row, column]))
        slope_word = np.bincount(words, y - p, len(counts))
        slope = np.bincount(feature, slope_word[owner], len(place)) - 0.02 * w
        right = np.exp(np.clip(scores[:, 1:], -40, 40)) * back[:, 1:]
        m = np.exp(moves)
        joint = np.stack([m[0, 0] * np.ones_like(right), m[0, 1] * right, m[1, 0] * ahead[:, :-1], m[1, 1] * ahead[:, :-1] * right])
        expected = (joint / joint.sum(0)).sum((1, 2)).reshape(2, 2)
        slope_m = true_moves - expected - 0.02 * moves
        slope_b = (y - p).sum()
        square += (slope / total * 1e3) ** 2
        square_m += (slope_m / total * 1e3) ** 2
        square_b += (slope_b / total * 1e3) ** 2
        w += 0.6 * (slope / total * 1e3) / np.sqrt(square)
        moves += 0.3 * (slope_m / total * 1e3) / np.sqrt(square_m)
        bias += 0.3 * (slope_b / total * 1e3) / np.sqrt(square_b)
    weights = np.zeros(1 << BITS, np.float32)
    weights[place] = w
    model = Model(weights, float(bias), moves, empty.calibration, prior)
    # the calibration: a weighted logistic regression on what scoring will see
    seen = Emissions(model)
    x = np.stack([summary(odds) for odds in document_odds([np.array([seen[t] for t in text.split()]) for text, _ in rows], moves)])
    x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    weight = np.where(y_doc, shares[1], shares[0])
    weight = weight / weight.mean()
    c = np.zeros(3)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        slope = x.T @ (weight * (y_doc - p)) - 0.5 * np.array([0, 1, 1]) * c
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([1e-3, 0.5, 0.5])
        c += np.clip(np.linalg.solve(bend, slope), -2, 2)
    model.calibration = c
    return model


def document_odds(scores: list[np.ndarray], moves: np.ndarray) -> list[np.ndarray]:
    """The marginal log odds of each document's tokens, every document one chain."""
    lengths = np.array([len(s) for s in scores], np.int64)
    if not lengths.sum():
        return [np.zeros(0) for _ in scores]
    row, column, n = chains(lengths)
    grid, used = np.full((n, CHAIN), PAD), np.zeros((n, CHAIN), bool)
    grid[row, column] = np.concatenate(scores)
    used[row, column] = True
    per = -(-lengths // CHAIN)
    first = np.cumsum(per) - per
    ahead_in, back_in = np.full(n, np.nan), np.ones(n)
    if per.max() > 1:
        long = np.flatnonzero(per > 1)
        long = long[np.argsort(-per[long], kind="stable")]
        some = np.concatenate([np.arange(first[i], first[i] + per[i]) for i in long])
        forth, back = np.zeros((4, n)), np.zeros((4, n))
        forth[:, some], back[:, some] = transfers(grid[some], moves, used[some])
        # the first row's outgoing message: its first token has none before it
        heads = first[long]
        ahead_in[heads + 1] = posteriors(grid[heads], moves)[1][:, -1]
        for k in range(1, int(per[long[0]])):
            long = long[per[long] > k]
            a, at = ahead_in[first[long] + k], first[long] + k
            more = per[long] > k + 1
            ahead_in[at[more] + 1] = ((forth[0, at] * a + forth[1, at]) / (forth[2, at] * a + forth[3, at]))[more]
        long = np.flatnonzero(per > 1)
        long = long[np.argsort(-per[long], kind="stable")]
        for k in range(1, int(per[long[0]])):
            long = long[per[long] > k]
            at = first[long] + per[long] - k
            b = back_in[at]
            back_in[at - 1] = (back[0, at] * b + back[1, at]) / (back[2, at] * b + back[3, at])
    odds = posteriors(grid, moves, ahead_in, back_in, used)[0][row, column]
    return np.split(odds, np.cumsum(lengths)[:-1])


def summary(odds: np.ndarray) -> np.ndarray:
    """Of a document: log of 1 + expected toxic tokens, and its largest log odds; an empty one has the least."""
    if not len(odds):
        return np.array([0.0, -10.0])
    return np.array([np.log1p((1 / (1 + np.exp(-odds))).sum()), float(np.clip(odds.max(), -10, 10))])


def sampled(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, tuple[float, float]]:
    """The training rows (_id, _t, _y) of labelled documents that are not held out, about so many of each label: those with the least hashes.

    A doc_id with several labels is toxic if one says so; of rows that repeat a doc_id the
    least text stands for it, so the sample's bound holds however often ids recur.
    """
    usable = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL AND crc32(cast(doc_id AS string)) % 4 <> 2").groupBy(F.col("doc_id").alias("_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("_y"))
    sizes = {r["_y"]: r["count"] for r in usable.groupBy("_y").count().collect()}
    picks, shares = None, []
    for y, most in ((0, SAMPLE_CLEAN), (1, SAMPLE_TOXIC)):
        chosen = hash_sample(usable.where(F.col("_y") == y), F.col("_id"), sizes.get(y, 0), most)
        picks = chosen if picks is None else picks.unionByName(chosen)
        shares.append(sizes.get(y, 0) / max(1, min(most, sizes.get(y, 0))))
    text = F.col("text").cast("binary")
    found = docs.select("doc_id", text.alias("_t")).where(F.octet_length("_t") <= SAMPLE_BYTES).join(F.broadcast(picks), F.col("doc_id") == F.col("_id"))
    return found.groupBy("_id").agg(F.min("_t").alias("_t"), F.first("_y").alias("_y")), tuple(shares)


def fitted(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from labels (doc_id, toxic) of docs; the sample's bounds are the constants above.

    One task trains; what comes back is the model, a number for each feature of the sample.
    """
    rows, shares = sampled(docs, labels)

    def learn(batches):
        sample = [(t, y, i) for batch in batches for i, t, y in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        sample.sort(key=lambda r: (zlib.crc32(str(r[2]).encode()), r[2]))
        yield pa.RecordBatch.from_arrays([pa.array([train(distinct([r[:2] for r in sample]), shares).packed()], pa.binary())], ["model"])

    found = rows.select("_id", "_t", "_y").coalesce(1).mapInArrow(learn, "model binary").collect()
    return Model.unpacked(bytes(found[0]["model"])) if found else train([], shares)


_caches: dict[int, tuple[bytes, Model, Emissions]] = {}


def scored(docs: DataFrame, model: Model, spans: bool = True) -> DataFrame:
    """Every column of docs, and score and toxic_spans (start and stop in bytes, probability).

    Each text is scored whole, from its words only.  A null or empty text has the score of
    a document without toxic words and no spans; equal texts have equal scores.  Columns of
    these names are replaced; an empty table gives none.  With spans=False toxic_spans is null.
    """
    kept = [c for c in docs.columns if c not in ("score", "toxic_spans")]
    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    shared = docs.sparkSession.sparkContext.broadcast(model.packed())
    span = pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("probability", pa.float64())])

    def offending(text: bytes, odds: np.ndarray) -> list[dict]:
        if not len(odds) or odds.max() <= 0:
            return []
        p = 1 / (1 + np.exp(-odds))
        return [{"start": m.start(), "stop": m.end(), "probability": float(p[i])} for i, m in enumerate(_WORD.finditer(text)) if odds[i] > 0]

    def run(batches):
        data = shared.value
        held = _caches.get(id(data))
        if held is None:
            _caches.clear()
            m = Model.unpacked(data)
            held = _caches[id(data)] = (data, m, Emissions(m))
        _, m, seen = held
        for batch in batches:
            texts = batch.column(len(kept))
            for a, b in slices(byte_lengths(texts), 2 << 20):
                data = [x or b"" for x in texts[a:b].to_pylist()]
                split = [x.split() for x in data]
                odds = document_odds([np.fromiter(map(seen.__getitem__, words), np.float64, len(words)) for words in split], m.moves)
                x = np.stack([summary(o) for o in odds])
                score = 1 / (1 + np.exp(-np.clip(m.calibration[0] + x @ m.calibration[1:], -30, 30)))
                where = [offending(t, o) for t, o in zip(data, odds, strict=True)] if spans else [None] * len(data)
                yield pa.RecordBatch.from_arrays([*(c[a:b] for c in batch.columns[:-1]), pa.array(score, pa.float64()), pa.array(where, pa.list_(span))], [*kept, "score", "toxic_spans"])

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in kept), "score double, toxic_spans array<struct<start:bigint,stop:bigint,probability:double>>"])
    return docs.select(*kept, F.col("text").cast("binary").alias("_scored_text")).mapInArrow(run, schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted, and toxic_spans: the offending words' byte offsets and probabilities."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, fitted(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "toxic_spans")
