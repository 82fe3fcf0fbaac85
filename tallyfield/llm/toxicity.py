"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's vector is the mean of its own hashed vector and those of its character 3- to 5-grams,
so a misspelling that was never seen shares most of its vectors with the word it stands for. A
document is the mean of its words' vectors, ``SCALE`` times as long, and a softmax of two classes
reads that mean. The embeddings and the softmax are learnt together by gradient descent, both
classes weighing the same. Only subwords whose share of documents differs between the classes by
``SEEN`` standard errors and that are in four documents have vectors, so that single documents are
not memorised; the others' are zero. With fewer than ``SEEN`` squared documents of a class the
square root of their number does, and three documents, as no word of a few could differ by more.

Training reads a bounded sample of labelled documents, by smallest hash of the id: of each class
at most ``max_docs``, as long as they have ``max_chars`` code points together (a document that
would exceed them is passed over); documents whose CRC-32 of the id leaves 0 modulo 5 are never learnt from. Scoring
reads every document whole.

Defined results: a null, empty or wordless text gets the score of an empty bag, which is below
0.5. Without labels of both classes every score is 0. Rows that repeat stay repeated, but are
learnt once; repeated labels of a document count once, as toxic if any says so. A document with a
null id is scored and never learnt from. No rows in, no rows out.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, named

BUCKETS, DIM, MAX_DOCS, MAX_CHARS, HELD, SEEN, SCALE = 1 << 18, 4, 1500, 3_000_000, 300_000, 4.0, 50.0
MIX = np.uint32(0x9E3779B1)
WORD = re.compile(r"[^\W\d_]+")
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def grams_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of every word's own vector and of its character 3- to 5-grams, ends marked."""
    points = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(w) + 2 for w in words])
    word = np.repeat(np.arange(len(words)), sizes)
    owners = [np.arange(len(words))]
    buckets = [np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words], np.uint32)]
    hashed = points * MIX
    for n in range(2, 6):
        hashed = (hashed[:-1] ^ (hashed[:-1] >> np.uint32(13))) * MIX + points[n - 1 :]
        if n > 2:
            inside = word[: len(hashed)] == word[n - 1 :]
            owners.append(word[: len(hashed)][inside])
            buckets.append((hashed ^ (hashed >> np.uint32(16)))[inside] + np.uint32(n))
        if len(hashed) < 2:
            break
    return np.concatenate(owners), (np.concatenate(buckets) % BUCKETS).astype(np.int64)


@dataclass
class Model:
    """What scoring needs of embeddings and softmax: each bucket's toxic logit and the bias."""

    direction: np.ndarray
    base: float
    held: dict[str, float] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"held": {}}

    def learn(self, words: set[str]) -> dict[str, float]:
        """What each word adds to the toxic logit of a bag of itself alone; at most ``HELD`` are kept."""
        if len(self.held) > HELD:
            self.held = {}
        if new := list(words - self.held.keys()):
            owner, bucket = grams_of(new)
            means = np.bincount(owner, self.direction[bucket], len(new)) / np.bincount(owner, minlength=len(new))
            self.held.update(zip(new, means.tolist(), strict=True))
        return self.held

    def raw(self, words: list[str]) -> float:
        if not words:
            return min(self.base, -1.0)
        return self.base + SCALE * math.fsum(map(self.held.__getitem__, words)) / len(words)

    def scores(self, texts: list[str | None]) -> list[float]:
        found: list[float] = []
        for at in range(0, len(texts), 256):
            docs = [words_of(t) for t in texts[at : at + 256]]
            self.learn(set().union(*docs))
            found += [1 / (1 + math.exp(-min(max(self.raw(d), -30.0), 30.0))) for d in docs]
        return found


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


@dataclass
class Bags:
    """Training documents as word counts, and the vocabulary's subwords, word by word."""

    truth: np.ndarray
    sizes: np.ndarray
    doc: np.ndarray
    word: np.ndarray
    times: np.ndarray
    bucket: np.ndarray
    per_word: np.ndarray

    @classmethod
    def of(cls, labelled: Iterable[tuple[str, int]]) -> Bags:
        number: dict[str, int] = {}
        truth, sizes, words, times = [], [], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        for text, label in labelled:
            found = words_of(text)
            own, many = np.unique(np.array([number.setdefault(w, len(number)) for w in found], np.int32), return_counts=True)
            truth.append(int(label))
            sizes.append(max(len(found), 1))
            words.append(own)
            times.append(many.astype(np.int32))
        vocabulary, buckets, per_word = list(number), [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for at in range(0, len(vocabulary), 8192):
            owner, bucket = grams_of(vocabulary[at : at + 8192])
            buckets.append(bucket[np.argsort(owner, kind="stable")].astype(np.int32))
            per_word.append(np.bincount(owner))
        doc = np.repeat(np.arange(len(truth)), [len(x) for x in words[1:]])
        return cls(np.array(truth, np.int64), np.array(sizes, float), doc, np.concatenate(words), np.concatenate(times), np.concatenate(buckets), np.concatenate(per_word))

    def known(self) -> np.ndarray:
        """Buckets whose share of documents tells the classes apart."""
        total = np.bincount(self.truth, minlength=2)
        starts = np.cumsum(self.per_word) - self.per_word
        held = np.zeros((2, BUCKETS), np.int64)
        for k, words in enumerate(np.split(self.word, np.searchsorted(self.doc, np.arange(1, len(self.truth))))):
            n = self.per_word[words]
            places = np.repeat(starts[words] - np.cumsum(n) + n, n) + np.arange(n.sum())
            held[self.truth[k], np.unique(self.bucket[places])] += 1
        share = held.sum(0) / total.sum()
        error = np.sqrt(share * (1 - share) * (1 / total).sum()) + 1e-9
        seen = min(SEEN, math.sqrt(total.min()))
        return (held.sum(0) >= (4 if seen == SEEN else 3)) & (np.abs(held[1] / total[1] - held[0] / total[0]) > seen * error)


def summed(index: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(index, values[:, d], n) for d in range(values.shape[1])], 1)


def fit(labelled: Iterable[tuple[str, int]], epochs: int = 150, rate: float = 0.05, seed: int = 3) -> Model | None:
    """Embeddings and softmax by full-batch Adam over documents; both classes weigh the same."""
    bags = Bags.of(labelled)
    if len(set(bags.truth.tolist())) < 2:
        return None
    known = bags.known()
    # words and subwords without a vector are counted in the means and nowhere else
    owner, bucket = np.repeat(np.arange(len(bags.per_word)), bags.per_word), (np.cumsum(known) - 1)[bags.bucket]
    live = known[bags.bucket]
    owner, bucket = owner[live], bucket[live]
    words, owner = np.unique(owner, return_inverse=True)
    per_word = bags.per_word[words][:, None].astype(float)
    place = np.full(len(bags.per_word), -1)
    place[words] = np.arange(len(words))
    live = place[bags.word] >= 0
    doc, word = bags.doc[live], place[bags.word][live]
    share = bags.times[live][:, None] * (SCALE / bags.sizes)[doc][:, None]
    n = len(bags.truth)
    weight = (0.5 / np.bincount(bags.truth))[bags.truth][:, None]
    wanted = np.eye(2)[bags.truth]
    rng = np.random.default_rng(seed)
    weights = [rng.normal(0, 0.1, (int(known.sum()), DIM)), rng.normal(0, 0.3, (DIM, 2)), np.zeros(2)]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    for epoch in range(epochs):
        table, softmax, bias = weights
        vectors = summed(owner, table[bucket], len(words)) / per_word
        means = summed(doc, vectors[word] * share, n)
        z = means @ softmax + bias
        p = np.exp(z - z.max(1, keepdims=True))
        p = (p / p.sum(1, keepdims=True) - wanted) * weight
        back = summed(word, (p @ softmax.T)[doc] * share, len(words)) / per_word
        slopes = [summed(bucket, back[owner], len(table)) + 1e-5 * table, means.T @ p + 1e-4 * softmax, p.sum(0)]
        for w, g, (m, v) in zip(weights, slopes, moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= rate * (m / (1 - 0.9 ** (epoch + 1))) / (np.sqrt(v / (1 - 0.99 ** (epoch + 1))) + 1e-6)
    direction = np.zeros(BUCKETS, np.float32)
    direction[known] = weights[0] @ (weights[1][:, 1] - weights[1][:, 0])
    return Model(direction, float(weights[2][1] - weights[2][0]))


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, max_chars: int = MAX_CHARS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model | None:
    marks = labels.where(named(label_col).isNotNull()).groupBy(named(id_col).cast("long").alias("doc_id")).agg((F.max(named(label_col)) > 0).cast("int").alias("mark"))
    marks = marks.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).withColumn("order", F.xxhash64("doc_id"))
    texts = docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).alias("text")).where(F.col("text").isNotNull())
    chosen: dict[int, int] = {}
    for mark in (0, 1):
        some = marks.where(F.col("mark") == mark).orderBy("order", "doc_id").limit(max_docs)  # at most so many rows are broadcast
        sizes = texts.select("doc_id", F.char_length("text").alias("chars")).join(F.broadcast(some), "doc_id").groupBy("order", "doc_id").agg(F.max("chars").alias("chars"))
        left = max_chars
        for r in sorted(sizes.collect()):
            if r.chars <= left:
                chosen[r.doc_id] = mark
                left -= r.chars
    if len(set(chosen.values())) < 2:
        return None
    ids = docs.sparkSession.createDataFrame(sorted(chosen.items()), "doc_id long, mark int")
    sample = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("mark").alias("mark")).toArrow().sort_by("doc_id")
    return fit(zip(sample.column("text").to_pylist(), sample.column("mark").to_pylist(), strict=True))


def score_toxicity(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, held_out, score, predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.scores(batch.column("text").to_pylist()) if model else [0.0] * batch.num_rows
            arrays = [pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *arrays], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(named(id_col).cast("long").alias("doc_id"), held_out(named(id_col)).alias("held_out"), named(text_col).alias("text"))
    return rows.mapInArrow(run, SCHEMA)
