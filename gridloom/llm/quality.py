"""Quality classifier: a weak-label model and a hashed linear scorer.

Eight heuristic labellers vote good, bad or nothing on every whole text. Expectation-maximisation over the counts of
vote patterns (at most 3**8, whatever the input) estimates each labeller's accuracies and the share of good texts. The
posteriors of a bounded sample of texts (``sample``, default 4000, those of least hash) train a linear scorer on hashed
shape n-grams and text statistics; it scores every text, and a text is accepted from ``threshold`` on.

Cases: null and empty text is rejected with score 0; repeated rows are judged alike; with no rows to learn from nothing
is rejected but empty texts; a null doc_id is kept; other columns pass by (``accepted_documents`` keeps all columns).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import _text as T
from gridloom.llm._spark import only, stored

WIDTH = 1 << 12
#: Features beside the hashed n-grams.
EXTRA = 9
LABELLERS = ("symbols", "capitals", "adjacent", "trigrams", "wordless", "length", "ends", "stops")

# Frequent function words of four languages.
FUNCTION_WORDS = "the of and to in a is that for it as with was on are by this from an la el de que y en los las se un una por con para der die das und ist nicht ein eine zu von mit den im le les des et est dans pour du au qui sur pas".split()

_UPPER = np.zeros(256, dtype=np.int64)
_UPPER[65:91] = 1
_ALPHA = np.zeros(256, dtype=np.int64)
_ALPHA[65:91] = _ALPHA[97:123] = 1
_ALPHA[128:] = 1
_ODD = np.zeros(256, dtype=np.int64)
_ODD[[ord(c) for c in "#$%&*|{}<>\\^~=+_@/[]!"]] = 1
_END = np.zeros(256, dtype=np.int64)
_END[[ord(c) for c in ".!?"]] = 1


def _shape_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[97:123] = 97
    t[65:91] = 65
    t[48:58] = 48
    t[128:] = 97
    return t


_SHAPE = _shape_table()


def _function_hashes() -> np.ndarray:
    data, bounds = T.utf8(pa.array([" ".join(FUNCTION_WORDS)]))
    return np.sort(T.Words(data, bounds, T.ALNUM_WORD).hash)


_STOPS = _function_hashes()
STATS = ("odd", "upper", "adjacent", "distinct", "trigram", "bare", "mean", "ends", "stops", "size")


def statistics(words: T.Words) -> np.ndarray:
    """A row of STATS for each text."""
    buf, at = words.bytes, words.row_bytes
    per = lambda v, edges: np.diff(np.concatenate([[0], np.cumsum(v)])[edges])
    alpha, upper, odd, ends = (per(t[buf], at) for t in (_ALPHA, _UPPER, _ODD, _END))
    n = np.diff(words.first)
    h = words.hash
    same = np.zeros(len(h), dtype=np.int64)
    same[1:] = h[1:] == h[:-1]
    letters = np.concatenate([[0], np.cumsum(_ALPHA[buf])])
    bare = (letters[words.ends] - letters[words.starts] == 0).astype(np.int64)
    stop = _STOPS[np.minimum(np.searchsorted(_STOPS, h), len(_STOPS) - 1)] == h
    starts, first = words.windows(3)
    tri = words.window(starts, 3)
    some = np.maximum(n, 1)
    distinct, fresh = np.ones(len(n)), np.ones(len(n))
    for i in range(len(n)):
        a, b = words.first[i], words.first[i + 1]
        if b > a:
            distinct[i] = len(np.unique(h[a:b])) / (b - a)
        if first[i + 1] > first[i]:
            fresh[i] = len(np.unique(tri[first[i] : first[i + 1]])) / (first[i + 1] - first[i])
    spread = per((words.ends - words.starts), words.first)
    return np.stack([odd / np.maximum(alpha, 1), upper / np.maximum(alpha, 1), per(same, words.first) / some, distinct, fresh, per(bare, words.first) / some, spread / some, ends / some, per(stop.astype(np.int64), words.first) / some, n], axis=1).astype(float)


def votes(s: np.ndarray) -> np.ndarray:
    """1 good, 0 bad, -1 no vote; a column for each of LABELLERS."""
    odd, upper, adjacent, _, trigram, bare, mean, ends, stops, n = s.T
    judge = lambda bad, good: np.where(bad, 0, np.where(good, 1, -1))
    long = n >= 20
    return np.stack(
        [
            judge(odd > 0.06, odd < 0.03),
            judge((upper > 0.5) & (n >= 3), upper < 0.25),
            judge((adjacent > 0.3) & (n >= 5), long & (adjacent < 0.1)),
            judge(long & (trigram < 0.5), long & (trigram > 0.8)),
            judge((bare > 0.2) & (n >= 5), bare < 0.05),
            judge((mean < 2.5) | (mean > 14), (mean > 3.2) & (mean < 9)),
            judge(long & (ends > 0.35), long & (ends > 0.01) & (ends < 0.25)),
            judge(long & (stops < 0.02), long & (stops > 0.1)),
        ],
        axis=1,
    ).astype(np.int64)


def pattern(v: np.ndarray) -> np.ndarray:
    return ((v + 1) * 3 ** np.arange(v.shape[1])).sum(axis=1)


def unpattern(code: np.ndarray) -> np.ndarray:
    return code[:, None] // 3 ** np.arange(len(LABELLERS)) % 3 - 1


def posteriors(codes: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """Expectation-maximisation: P(good) of each vote pattern; P(vote | class, it votes) as (class, labeller, vote); P(good).
    No vote says nothing of a text, so short texts, on which few vote, stay near the prior.

    Starts from the majority with accuracies of 0.8; the counts are smoothed by a pseudo-count that keeps a vote for
    good likelier under good, so the classes keep their meaning."""
    v = unpattern(codes)
    prior, table = 0.8, np.zeros((2, len(LABELLERS), 2))
    table[1], table[0] = [0.1, 0.9], [0.6, 0.4]
    pseudo = np.array([[4.0, 1.0], [0.5, 4.0]])
    good = np.full(len(codes), prior)
    for _ in range(rounds):
        log = [np.log(p) + sum(np.where(v[:, j] >= 0, np.log(table[c, j, v[:, j]]), 0) for j in range(len(LABELLERS))) for c, p in ((0, 1 - prior), (1, prior))]
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        done = np.abs(new - good).max(initial=0) < 1e-9
        good = new
        for c, r in ((0, (1 - good) * counts), (1, good * counts)):
            for j in range(len(LABELLERS)):
                said = v[:, j] >= 0
                t = np.bincount(v[said, j], weights=r[said], minlength=2) + pseudo[c]
                table[c, j] = t / t.sum()
        prior = float(np.clip((good @ counts + 2) / (counts.sum() + 4), 0.02, 0.98))
        if done:
            break
    return good, table, prior


def _vector(counts: np.ndarray, stats: np.ndarray) -> np.ndarray:
    x = np.sqrt(counts / max(counts.sum(), 1))
    odd, upper, adjacent, distinct, trigram, bare, mean, ends, stops, n = stats
    long = float(n >= 20)
    extra = [1.0, min(odd * 5, 2), upper, adjacent * 2, long * (1 - trigram) * 3, bare * 2, min(mean / 10, 2), long * min(ends, 1), long * stops * 2]
    return np.concatenate([x, extra])


def _vectors(data: np.ndarray, bounds: np.ndarray):
    words = T.Words(data, bounds, T.BLANK_WORD)
    stats = statistics(words)
    for i, c in enumerate(T.gram_counts(data, bounds, _SHAPE, (2, 3, 4), WIDTH)):
        yield _vector(c, stats[i])


def _vote(batches):
    for batch in batches:
        data, bounds = T.utf8(batch.column(1))
        for lo, hi in T.pieces(bounds):
            code = pattern(votes(statistics(T.Words(data, bounds[lo : hi + 1], T.BLANK_WORD))))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(code)], names=["doc_id", "pattern"])


def _sampled(batches):
    """Feature vectors as bytes of their non-zero places (16 bits) and values (float32), so that the sample travels small."""
    for batch in batches:
        data, bounds = T.utf8(batch.column(1))
        for lo, hi in T.pieces(bounds):
            at, x = [], []
            for v in _vectors(data, bounds[lo : hi + 1]):
                i = np.flatnonzero(v)
                at.append(i.astype(np.uint16).tobytes())
                x.append(v[i].astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(at, pa.binary()), pa.array(x, pa.binary())], names=["doc_id", "pattern", "at", "x"])


def _matrix(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The sample's vectors as one float32 matrix in the order of (doc_id, pattern), and their patterns."""
    codes = np.asarray(rows.column("pattern"))
    order = np.lexsort((codes, np.asarray(rows.column("doc_id"))))
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    x = np.zeros((len(order), WIDTH + EXTRA), dtype=np.float32)
    for i, at, v in zip(place, rows.column("at"), rows.column("x"), strict=True):
        x[i, np.frombuffer(at.as_buffer(), dtype=np.uint16)] = np.frombuffer(v.as_buffer(), dtype=np.float32)
    return x, codes[order]


def fit_linear(x: np.ndarray, y: np.ndarray, rounds: int = 300, rate: float = 0.3, l2: float = 1e-4) -> np.ndarray:
    """Weights of logistic regression on soft labels, both classes of equal total weight, by AdaGrad on full batches."""
    w, seen = np.zeros(x.shape[1]), np.full(x.shape[1], 1e-8)
    y = y.astype(float)
    weigh = y / max(y.sum(), 1e-9) + (1 - y) / max((1 - y).sum(), 1e-9)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w.astype(x.dtype), -50, 50)))
        g = (weigh * (p - y)).astype(x.dtype) @ x + l2 * w
        seen += g * g
        w -= rate * g / np.sqrt(seen)
    return w


def _score(held, at: int, threshold: float | None):
    """doc_id and score of the rows, or with a threshold the rows that reach it."""

    def run(batches):
        w = held.value
        for batch in batches:
            data, bounds = T.utf8(batch.column(at))
            for lo, hi in T.pieces(bounds):
                p = np.ones(hi - lo)
                if w is not None:
                    p = np.array([1 / (1 + np.exp(-np.clip(v @ w, -50, 50))) for v in _vectors(data, bounds[lo : hi + 1])])
                p[np.diff(bounds[lo : hi + 1]) == 0] = 0.0
                part = batch.slice(lo, hi - lo)
                if threshold is None:
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p)], names=["doc_id", "score"])
                else:
                    yield part.filter(pa.array(p >= threshold))

    return run


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = 4000) -> np.ndarray | None:
    """Weights of the scorer, learned from docs without labels."""
    base = only(docs, doc_id=f"{key}:bigint", text=f"{text}:string").filter("length(text) > 0")
    voted = stored(base.mapInArrow(_vote, "doc_id long, pattern long"), "votes")
    counts = voted.groupBy("pattern").count().toArrow()
    if not counts.num_rows:
        return None
    codes, n = (np.asarray(counts.column(i)) for i in range(2))
    order = np.argsort(codes)
    codes = codes[order]
    good, _, _ = posteriors(codes, n[order].astype(float))
    chosen = voted.filter("doc_id is not null").orderBy(F.xxhash64("doc_id", "pattern"), "doc_id").limit(sample).distinct()
    rows = base.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "pattern").mapInArrow(_sampled, "doc_id long, pattern long, at binary, x binary").toArrow()
    if not rows.num_rows:
        return None
    x, said = _matrix(rows)
    del rows
    w = fit_linear(x, good[np.searchsorted(codes, said)])
    del x
    T.release()
    return w


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = 4000, threshold: float = 0.5) -> DataFrame:
    """doc_id, score, accepted of each row."""
    w = docs.sparkSession.sparkContext.broadcast(train(docs, key, text, sample))
    base = only(docs, doc_id=f"{key}:bigint", text=f"{text}:string")
    return base.mapInArrow(_score(w, 1, None), "doc_id long, score double").select("doc_id", "score", (F.col("score") >= threshold).alias("accepted"))


def accepted_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = 4000, threshold: float = 0.5) -> DataFrame:
    """docs, same columns, without the rows that the scorer rejects."""
    w = docs.sparkSession.sparkContext.broadcast(train(docs, key, text, sample))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(_score(w, docs.columns.index(text), threshold), schema)


def op7(docs: DataFrame) -> DataFrame:
    return score_documents(docs)
