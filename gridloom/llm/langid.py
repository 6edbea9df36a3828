"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are character 1- to 4-grams of the whole text: code points, letters of any script lower-cased, all else blanks
and a run of them one; hashed to WIDTH slots; weight (1 + log tf) * idf, rows sparse and of unit length. The document
frequencies cover every training document. The regression learns by follow-the-regularised-leader (FTRL-proximal) with
elastic-net penalties on a bounded sample of labelled documents: at most ``per_language`` (default 500) of each language,
those of least hash. A part of the sample is kept from training and sets the temperature that calibrates the
probabilities.

Cases: a text that is null or has no letter is ``und`` with score 0; so is every text when nothing was learned (no
labelled training rows); a null lang isn't learned from; rows that repeat are judged each for itself; a null doc_id
hashes as empty text and isn't learned from; languages of equal probability go to the first by name, equal hashes in the
sample to the smaller doc_id; a very long text is counted whole, one text at a time; more than LANGUAGES_MOST languages
to learn are an error; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm import _text as T
from gridloom.llm._spark import only

WIDTH = 1 << 15
ORDERS = 4
#: Languages that a model may have; more is an error, as its weights grow with them.
LANGUAGES_MOST = 1000


def _fold_table() -> np.ndarray:
    """The lower-cased letter of each code point of the first plane, a blank for all others."""
    t = np.full(1 << 16, 32, dtype=np.uint32)
    for c in range(1 << 16):
        if chr(c).isalpha():
            low = chr(c).lower()
            t[c] = ord(low) if len(low) == 1 else c
    return t


_FOLD = _fold_table()


def _letters(raw: bytes) -> np.ndarray:
    """Code points of UTF-8 text, letters lower-cased and all else blanks, a run of blanks one; a blank at both ends."""
    code = np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    low = _FOLD[np.minimum(code, 0xFFFF)]
    for i in np.flatnonzero(code > 0xFFFF).tolist():
        low[i] = code[i] if chr(code[i]).isalpha() else 32
    low = np.concatenate([[32], low, [32]]).astype(np.uint32)
    return low[np.concatenate([[True], (low[1:] != 32) | (low[:-1] != 32)])]


def grams(raw: bytes) -> tuple[np.ndarray, np.ndarray] | None:
    """Slots of the hashed character 1- to 4-grams of a text and how often each occurs; None without a letter."""
    code = _letters(raw)
    if len(code) < 2:
        return None
    shift = np.uint32(32 - (WIDTH.bit_length() - 1))
    key, hashed = np.zeros(len(code), dtype=np.uint32), []
    for n in range(1, min(ORDERS, len(code)) + 1):
        key = code * np.uint32(0x01000193) if n == 1 else (key[:-1] * np.uint32(0x9E3779B1)) ^ (code[n - 1 :] * np.uint32(0x01000193))
        mixed = key ^ (key >> np.uint32(15))
        hashed.append(((mixed * np.uint32(2654435761) + np.uint32(n * 0x1F4A7C15)) >> shift).astype(np.int32))
    flat = np.concatenate(hashed)
    if len(flat) > WIDTH:
        count = np.bincount(flat, minlength=WIDTH)
        slots = np.flatnonzero(count).astype(np.int32)
        return slots, count[slots]
    return np.unique(flat, return_counts=True)


def _rows(batch: pa.RecordBatch, at: int, target: int = T.CHUNK_BYTES):
    """(lo, hi, grams of each row) over pieces of a batch, one text at a time."""
    data, bounds = T.utf8(batch.column(at))
    for lo, hi in T.pieces(bounds, target):
        yield lo, hi, (grams(data[bounds[i] : bounds[i + 1]].tobytes()) for i in range(lo, hi))


def _frequencies(batches):
    total, docs = np.zeros(WIDTH, dtype=np.int64), 0
    for batch in batches:
        for _, _, found in _rows(batch, 0):
            for g in found:
                docs += 1
                if g is not None:
                    total[g[0]] += 1
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, WIDTH, dtype=np.int32)), pa.array(np.concatenate([[docs], total]))], names=["slot", "n"])


def _sparse(batches):
    for batch in batches:
        for lo, _, found in _rows(batch, 2):
            for i, g in enumerate(found, lo):
                if g is not None:
                    own = [batch.column(c).slice(i, 1) for c in (0, 1)]
                    yield pa.RecordBatch.from_arrays([*own, pa.array([g[0].tolist()], pa.list_(pa.int32())), pa.array([g[1].tolist()], pa.list_(pa.int32()))], names=["order", "lang", "slots", "counts"])


def unit(slots: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF weights of the slots, of unit length."""
    x = (1 + np.log(counts)) * idf[slots]
    return x / max(float(np.sqrt((x * x).sum())), 1e-12)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Ftrl:
    """FTRL-proximal multinomial regression; l1 and l2 are the elastic net."""

    def __init__(self, width: int, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1):
        self.z, self.n = np.zeros((width, classes)), np.zeros((width, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, rows=slice(None)) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, rows: np.ndarray, values: np.ndarray, target: np.ndarray) -> None:
        w = self.weights(rows)
        g = values[:, None] * (softmax(values @ w) - target)[None, :]
        n = self.n[rows]
        self.z[rows] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[rows] = n + g * g


def temperature(logits: np.ndarray, gold: np.ndarray) -> float:
    """The temperature of least negative log-likelihood, by golden-section search on its logarithm."""
    if not len(gold):
        return 1.0

    def loss(s: float) -> float:
        p = softmax(logits / np.exp(s))
        return -float(np.log(np.maximum(p[np.arange(len(gold)), gold], 1e-12)).mean()) + 1e-4 * s * s

    a, b, r = -4.0, 4.0, (np.sqrt(5) - 1) / 2
    for _ in range(50):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


class Model:
    """Classes, idf, weights (the first row is the bias) and temperature."""

    def __init__(self, classes: list[str], idf: np.ndarray, weight: np.ndarray, heat: float):
        self.classes, self.idf, self.weight, self.heat = classes, idf, weight, heat

    def predict(self, slots: np.ndarray, counts: np.ndarray) -> tuple[str, float]:
        """The likeliest language, of equally likely ones the first by name, and its probability."""
        p = softmax((unit(slots, counts, self.idf) @ self.weight[slots + 1] + self.weight[0]) / self.heat)
        best = int(p.argmax())
        return self.classes[best], float(p[best])


def fit(rows: list[tuple], idf: np.ndarray, passes: int = 4) -> Model | None:
    """A model of sparse rows (order, lang, slots, counts); every eighth row calibrates."""
    rows = sorted(rows, key=lambda r: (r[0], r[1]))
    classes = sorted({r[1] for r in rows})
    if not classes:
        return None
    at = {c: i for i, c in enumerate(classes)}
    x = []
    for _, lang, slots, counts in rows:
        s = np.asarray(slots, dtype=np.int64)
        v = unit(s, np.asarray(counts, dtype=float), idf)
        x.append((np.concatenate([[0], s + 1]), np.concatenate([[1.0], v]), at[lang]))
    train = [r for i, r in enumerate(x) if i % 8] or x
    hold = [r for i, r in enumerate(x) if not i % 8] if len(x) >= 16 else []
    leader = Ftrl(WIDTH + 1, len(classes))
    for _ in range(passes):
        for s, v, y in train:
            leader.learn(s, v, np.eye(len(classes))[y])
    w = leader.weights()
    logits = np.array([v @ w[s] for s, v, _ in hold]).reshape(len(hold), len(classes))
    return Model(classes, idf, w, temperature(logits, np.array([y for *_, y in hold], dtype=int)))


def _predict(held):
    def run(batches):
        model = held.value
        for batch in batches:
            for lo, hi, found in _rows(batch, 1):
                lang, score = ["und"] * (hi - lo), np.zeros(hi - lo)
                for i, g in enumerate(found if model is not None else ()):
                    if g is not None:
                        lang[i], score[i] = model.predict(*g)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def _sample(known: DataFrame, per_language: int) -> DataFrame:
    """(doc_id, lang) of the per_language rows of least hash of each language (ties to the smaller doc_id). Languages with
    many rows first lose those whose hash is beyond twice the share that is wanted, so few rows of any are sorted."""
    order = F.xxhash64("doc_id")
    size = known.groupBy("lang").agg(F.count("*").alias("rows"))
    if size.limit(LANGUAGES_MOST + 1).count() > LANGUAGES_MOST:
        raise ValueError(f"more than {LANGUAGES_MOST} languages to learn")
    # A text repeats with its doc_id, so the share must hold per_language rows by far, or all.
    share = F.least(F.lit(1.0), F.lit(2.0 * per_language + 200) / F.col("rows"))
    few = known.select("doc_id", "lang").join(F.broadcast(size), "lang").filter((order.cast("double") / F.lit(2.0**64) + 0.5) <= share)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(order, "doc_id"))
    return few.withColumn("r", rank).filter(F.col("r") <= per_language).select("doc_id", "lang").distinct()


def train(docs: DataFrame, per_language: int = 500) -> Model | None:
    """Fit on docs(doc_id, text, lang), all of which may be learned from."""
    known = docs.filter("text is not null and lang is not null")
    idf_rows = known.select("text").mapInArrow(_frequencies, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(WIDTH + 1)
    n[np.asarray(idf_rows.column("slot")) + 1] = np.asarray(idf_rows.column("n"))
    idf = np.log((1 + n[0]) / (1 + n[1:])) + 1
    picked = _sample(known, per_language)
    rows = known.join(F.broadcast(picked), ["doc_id", "lang"]).select(F.xxhash64("doc_id").alias("order"), "lang", "text").mapInArrow(_sparse, "order long, lang string, slots array<int>, counts array<int>").toArrow()
    return fit([tuple(r.values()) for r in rows.to_pylist()], idf)


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 5, per_language: int = 500) -> DataFrame:
    """doc_id, held_out, lang_pred, score. held_out: crc32(doc_id as text) mod folds is 0; the rest is learned from."""
    base = only(docs, doc_id=f"{key}:bigint", text=f"{text}:string", lang=f"{lang}:string")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % folds == 0
    model = train(base.filter(~held), per_language)
    out = base.select("doc_id", "text", held.alias("held_out"))
    return out.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, held_out boolean, lang_pred string, score double")


def op5(docs: DataFrame) -> DataFrame:
    return identify(docs)
