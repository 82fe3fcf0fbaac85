"""Language identification by error-correcting output codes over character n-grams.

Every language gets a codeword of ``bits`` signs, chosen far apart; one binary logistic
classifier per bit predicts that sign from the document's hashed 1- to 3-gram frequencies.
Decoding is loss-weighted: each bit's logistic loss counts by how well the bit did in training,
and the nearest codeword wins. A document is flagged as ambiguous when the runner-up is close.

Training reads at most ``per_lang`` documents for each language (a bounded sample of labelled
rows, by smallest hash of the id; documents whose CRC-32 of the id leaves 0 modulo 5 are never
learnt from, and rows that repeat a document are learnt once). With more than ``FULL_LANGS``
languages each gets evenly fewer, one at least, so that all are learnt. Everything else reads
every document whole.

As a filter it keeps a document if its text has a letter and its two best codewords are at least
``reject_under`` of the probability apart; what is closer is in no language that was learnt.

Defined results: a null text, an empty text or one without any letter is ``und`` with score 0,
not ambiguous. With no labelled rows everything is ``und``. A single language has no bit to
tell and always wins. Repeated rows stay repeated. No rows in, no rows out.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out, named

DIMS, BITS, PER_LANG, FULL_LANGS, REJECT_UNDER = 4096, 15, 400, 16, 0.02
#: Parts of a language from which its sample is taken, and up to how many languages it is broadcast.
PARTS, FEW_LANGS = 16, 10_000
#: Texts whose features a task holds at a time.
ROWS = 128
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean"
#: Multipliers that spread code points over the n-gram buckets.
ODD = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def ngram_frequencies(texts: list[str | None], dims: int = DIMS) -> np.ndarray:
    """A row per text: frequencies of hashed character 1-, 2- and 3-grams, each kind summing to 1/3."""
    out = np.zeros((len(texts), dims), np.float32)
    for row, text in enumerate(texts):
        if not text:
            continue
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        hashed = np.zeros(len(points), np.uint32)
        for n in range(3):
            if len(points) <= n:
                break
            hashed = (hashed[: len(points) - n] + points[n:]) * ODD[n]
            mixed = (hashed ^ (hashed >> np.uint32(15))) % np.uint32(dims)
            out[row] += np.bincount(mixed, minlength=dims) / (3.0 * len(mixed))
    return out


def codewords(languages: int, bits: int, seed: int = 7) -> np.ndarray:
    """Rows of signs, no two alike; each next row is the farthest of many drawn from those before."""
    rng = np.random.default_rng(seed)
    rows = np.empty((max(languages, 1), bits), np.float32)
    rows[0] = np.where(np.arange(bits) % 2 == 0, 1, -1)
    for known in range(1, languages):
        drawn = rng.choice([-1, 1], (512, bits)).astype(np.float32)
        rows[known] = drawn[(drawn @ rows[:known].T).max(1).argmin()]
    return rows.astype(int)


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    bit_weights: np.ndarray
    scale: np.ndarray

    def decode(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest codeword, its score and the runner-up's."""
        margins = np.sqrt(features) * self.scale @ self.weights + self.bias
        # log(1 + exp(m)) is log(1 + exp(-m)) + m, so a product serves any number of languages
        loss = (np.logaddexp(0, -margins) @ self.bit_weights)[:, None] + (margins * self.bit_weights) @ (self.codes < 0).T
        fit = -loss / self.bit_weights.sum()
        p = np.exp((fit - fit.max(1, keepdims=True)) * self.codes.shape[1])
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        top = p[np.arange(len(p)), best]
        p[np.arange(len(p)), best] = 0
        return best, top, p.max(1) if p.shape[1] > 1 else np.zeros(len(p))


def fit(features: np.ndarray, labels: list[str], bits: int = BITS, steps: int = 300, ridge: float = 1e-4) -> Model:
    """Binary classifiers by full-batch gradient descent with momentum; each language weighs the same."""
    languages = sorted(set(labels))
    bits = max(bits, 2 * (len(languages) - 1).bit_length() + 1)
    codes = codewords(len(languages), bits)
    number = {x: k for k, x in enumerate(languages)}
    y_index = np.array([number[x] for x in labels])
    y = codes[y_index].astype(np.float32)
    x = np.sqrt(features)
    scale = (1 / (x.std(0) + 0.01)).astype(np.float32)
    x *= scale
    share = 1 / np.bincount(y_index, minlength=len(languages))[y_index]
    share = (share / share.sum())[:, None].astype(np.float32)
    w, b = np.zeros((x.shape[1], bits), np.float32), np.zeros(bits, np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    rate = 2.0 / max(1.0, float(np.einsum("ij,ij->i", x, x).mean()))
    for _ in range(steps):
        g = -y / (1 + np.exp(np.clip(y * (x @ w + b), -30, 30))) * share
        vw = 0.9 * vw - rate * (x.T @ g + ridge * w)
        vb = 0.9 * vb - rate * g.sum(0)
        w, b = w + vw, b + vb
    right = ((np.sign(x @ w + b) == y) * share).sum(0) if len(languages) > 1 else np.ones(bits)
    return Model(languages, codes, w, b, np.clip(2 * right - 1, 0.05, 1), scale)


def with_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            batch = whole.slice(at, ROWS)
            f = ngram_frequencies(batch.column("text").to_pylist()).astype(np.float16)
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array([r.tobytes() for r in f], pa.binary())], ["lang", "features"])


def train(docs: DataFrame, per_lang: int = PER_LANG, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    rows = docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).alias("text"), named(lang_col).alias("lang"))
    rows = rows.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & (F.length("text") > 0))
    known = rows.select("lang", "doc_id").distinct()
    languages = known.select("lang").distinct().count()
    per_lang = min(per_lang, max(1, FULL_LANGS * per_lang // max(1, languages)))
    # the smallest hashes of each language, first of its parts, however large it is
    ids = known.withColumns({"at": F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)), "part": F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(PARTS))})
    for keys in (["lang", "part"], ["lang"]):
        ids = ids.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("at", "doc_id"))).where(F.col("n") <= per_lang).drop("n")
    ids = ids.select("lang", "doc_id")
    ids = F.broadcast(ids) if languages <= FEW_LANGS else ids  # then at most 10,000 rows, as more languages have fewer each
    chosen = rows.join(ids, ["lang", "doc_id"]).groupBy("lang", "doc_id").agg(F.min("text").alias("text"))
    found = chosen.select("lang", "text").mapInArrow(with_features, "lang string, features binary").toArrow()
    if not found.num_rows:
        return None
    order = sorted(zip(found.column("lang").to_pylist(), found.column("features").to_pylist(), strict=True))
    features = np.empty((len(order), DIMS), np.float32)
    for row, (_, own) in zip(features, order, strict=True):
        row[:] = np.frombuffer(own, np.float16)
    return fit(features, [lang for lang, _ in order])


def predict_languages(docs: DataFrame, model: Model | None, ambiguous_under: float = 0.2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, held_out, lang_pred, score, ambiguous (by the two best codewords)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[str, float, bool]] = []
            for some in (batch.column("text").slice(i, ROWS).to_pylist() for i in range(0, batch.num_rows, ROWS)):
                if model is None:
                    rows += [("und", 0.0, False)] * len(some)
                    continue
                best, top, second = model.decode(ngram_frequencies(some))
                for t, k, p, q in zip(some, best, top, second, strict=True):
                    letter = t is not None and any(map(str.isalpha, t))
                    rows.append((model.languages[k], float(p), bool(p - q < ambiguous_under)) if letter else ("und", 0.0, False))
            columns = list(zip(*rows, strict=True)) if rows else [(), (), ()]
            arrays = [pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.float64(), pa.bool_()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *arrays], ["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    rows = docs.select(named(id_col).cast("long").alias("doc_id"), held_out(named(id_col)).alias("held_out"), named(text_col).alias("text"))
    return rows.mapInArrow(run, SCHEMA)


def keep_identified(docs: DataFrame, model: Model | None, reject_under: float = REJECT_UNDER, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text is in some language.

    Without a model the language is undecided, and every text with a letter is kept just so; a
    model of a single language decides as little.
    """
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for at in range(0, batch.num_rows, ROWS):
                some = batch.column(names.index(text_col)).slice(at, ROWS).to_pylist()
                apart = np.ones(len(some))
                if model is not None and len(model.languages) > 1:
                    _, top, second = model.decode(ngram_frequencies(some))
                    apart = top - second
                keep[at : at + ROWS] = [t is not None and any(map(str.isalpha, t)) and gap >= reject_under for t, gap in zip(some, apart, strict=True)]
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def distances(model: Model) -> list[int]:
    """How many bits tell each pair of languages apart."""
    return [int((a != b).sum()) for a, b in itertools.combinations(model.codes, 2)]
