"""Exact encoding with a public tokenizer, one cached whitespace-bounded chunk at a time.

Both vocabularies split text so that no token crosses a single space between two characters
that aren't white space. A text is cut there, each distinct chunk is encoded once per task,
and the cached pieces are joined; the outcome is what encoding the whole text gives.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
from pathlib import Path

import numpy as np

BREAK = re.compile(r"(?<=\S) (?=\S)")
DOUBLE = re.compile(r"\s\s")
#: A word without white space inside, apostrophe or start of a special token.
PLAIN = re.compile(r" ?[^\s<']+")
#: Latin letters, then ASCII marks.
STEM = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]+)")


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def chunks(text: str) -> list[str]:
    """The text cut at single spaces between other characters; each cut takes the space out."""
    return BREAK.split(text) if DOUBLE.search(text) else text.split(" ")


def vocabulary(path: str) -> tuple[dict, dict[str, int], dict[str, int]] | None:
    """The file, its tokens, and the byte each of their characters stands for.

    None where ids don't follow the order of merges, as then ids aren't ranks.
    """
    spec = json.loads(Path(path).read_text())
    vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
    ids = [vocab.get(a.removesuffix("</w>") + b if a.endswith("</w>") else a + b, -1) for a, b in pairs]
    if ids != list(range(ids[0], ids[0] + len(ids))) or max(vocab[t] for t in vocab if len(t.removesuffix("</w>")) == 1) >= ids[0]:
        return None
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = dict(zip(map(chr, printable), printable, strict=True))
    shown.update((chr(256 + k), b) for k, b in enumerate(b for b in range(256) if b not in set(printable)))
    special = {t["content"] for t in spec["added_tokens"]}
    return spec, {t: i for t, i in vocab.items() if t not in special}, shown


def parted(ids: np.ndarray, cuts: np.ndarray, skip: int) -> list[bytes]:
    """The ids between cuts, as bytes; ``skip`` ids after each cut belong to no part."""
    whole = ids.tobytes()
    return [whole[a:b] for a, b in zip([0, *(4 * (cuts + skip)).tolist()], [*(4 * cuts).tolist(), len(whole)], strict=True)]


class QuickBytes:
    """Words for a byte-level vocabulary, with a library that is faster on new words; ids are the same."""

    plain = PLAIN

    def __init__(self, tokens: dict[str, int], shown: dict[str, int]):
        import tiktoken

        ranks = {bytes(shown[c] for c in t): i for t, i in tokens.items()}
        pattern = r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.encoding = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.newline = self.encoding.encode_ordinary("\n")[0]

    def encode(self, words: list[str]) -> list[bytes]:
        ids = np.array(self.encoding.encode_ordinary("\n".join(words)), "<u4")
        return parted(ids, np.flatnonzero(ids == self.newline), 1)


class QuickLetters:
    """Latin words for a vocabulary with word ends: a zero byte stands for the end, which merges first."""

    plain = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")

    def __init__(self, tokens: dict[str, int], shown: dict[str, int]):
        import tiktoken

        ranks = {bytes(shown[c] for c in t.removesuffix("</w>")) + b"\0" * t.endswith("</w>"): i for t, i in tokens.items() if "Ā" not in t}
        ranks[b"\0"] = tokens["Ā"]
        self.encoding = tiktoken.Encoding("letters", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})
        self.ends = np.zeros(max(tokens.values()) + 1, bool)
        self.ends[[i for t, i in tokens.items() if t.endswith("</w>")]] = True

    def encode(self, words: list[str]) -> list[bytes]:
        ids = np.array(self.encoding.encode_ordinary("\0".join(words).lower() + "\0"), "<u4")
        return parted(ids, np.flatnonzero(self.ends[ids])[:-1] + 1, 0)


def quick_words(path: str) -> QuickBytes | QuickLetters | None:
    found = vocabulary(path)
    if not found:
        return None
    spec, tokens, shown = found
    if spec["normalizer"] is None and spec["pre_tokenizer"].get("type") == "ByteLevel":
        return QuickBytes(tokens, shown)
    if spec["model"]["end_of_word_suffix"] == "</w>" and {n["type"] for n in spec["normalizer"]["normalizers"]} == {"NFC", "Replace", "Lowercase"}:
        return QuickLetters(tokens, shown)
    return None


@functools.cache
def encoders(path: str) -> tuple:
    """The tokenizer and what is faster for plain words, once for a worker process."""
    return load(path), quick_words(path)


class ChunkCache:
    """Every chunk as little-endian 32-bit ids, computed once; ``prefix`` is put before each chunk.

    Letters that marks follow are encoded apart from the marks, which are rare in kind: no token
    crosses from one to the other. Beyond about ``limit`` bytes of memory the later half is
    forgotten, which changes speed alone; what came first is what is frequent.
    """

    def __init__(self, path: str, prefix: str = "", limit: int = 144 << 20):
        self.prefix, self.limit = prefix, limit
        self.tokenizer, self.quick = encoders(path)
        self.held: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}
        self.bytes = 0

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; plain words share a call."""
        out: list = [None] * len(texts)
        plain = [k for k, t in enumerate(texts) if self.quick.plain.fullmatch(t)] if self.quick else []
        for some in slices(plain, 4096):
            for k, own in zip(some, self.quick.encode([texts[k] for k in some]), strict=True):
                out[k] = own
        rest = [k for k, x in enumerate(out) if x is None]
        for some in slices(rest, 1024):
            for k, e in zip(some, self.tokenizer.encode_batch_fast([texts[k] for k in some], add_special_tokens=False), strict=True):
                out[k] = np.array(e.ids, "<u4").tobytes()
        return out

    def learn(self, parts: set[str]) -> dict[str, bytes]:
        held, marks = self.held, self.marks
        if self.bytes > self.limit:
            self.held = held = dict(itertools.islice(held.items(), len(held) // 2))
            self.bytes //= 2
        cut = {x: STEM.fullmatch(x) for x in parts.difference(held)}
        stems = {m[1] if m else x for x, m in cut.items()}.difference(held)
        tails = {m[2] for m in cut.values() if m}.difference(marks)
        held.update(zip(stems, self.encode([self.prefix + x for x in stems]), strict=True))
        marks.update(zip(tails, self.encode(list(tails)), strict=True))
        for x, m in cut.items():
            if m:
                held[x] = held[m[1]] + marks[m[2]]
        self.bytes += 240 * len(cut) + 5 * sum(map(len, cut))
        return held


@functools.cache
def _chunk_cache(path: str, prefix: str) -> ChunkCache:
    return ChunkCache(path, prefix)


def chunk_cache(path: str, prefix: str = "") -> ChunkCache:
    """One cache of each kind for a worker process, until it is told to ``forget``."""
    return _chunk_cache(path, prefix)


def forget() -> None:
    """Drop all chunks: a worker outlives its task, and other work would have less memory beside them."""
    _chunk_cache.cache_clear()


@functools.cache
def ahead(path: str) -> str | None:
    """What the first character of each later chunk is; None where texts can't be cut into chunks."""
    words = encoders(path)[1]
    return " " if isinstance(words, QuickBytes) else "" if words else None


def text_ids(path: str, texts: list[str]) -> list[bytes]:
    """The ids of whole texts, as little-endian 32-bit numbers."""
    if ahead(path) is None:
        return [np.array(e.ids, "<u4").tobytes() for e in chunk_cache(path).tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    first, rest = chunk_cache(path), chunk_cache(path, ahead(path))
    parts = [chunks(t) for t in texts]
    heads = first.learn({p[0] for p in parts})
    if first is rest:
        heads = first.learn(set().union(*parts))
        return [b"".join([heads[x] for x in p]) for p in parts]
    held = rest.learn(set().union(*(p[1:] for p in parts)))
    return [heads[p[0]] + b"".join([held[x] for x in p[1:]]) for p in parts]


@functools.cache
def id_names(path: str) -> tuple[list[str], list[str] | None]:
    """For each id its decimal digits and its token; no tokens where the vocabulary has a decoder of its own."""
    tokenizer = load(path)
    size = tokenizer.get_vocab_size()
    plain = tokenizer.decoder is None and "decoder" in (spec := json.loads(Path(path).read_text())) and spec["decoder"] is None
    return [str(i) for i in range(size)], [tokenizer.id_to_token(i) for i in range(size)] if plain else None


def decoded(path: str, ids: list[int]) -> str:
    """The library's decode; without a decoder it puts spaces between tokens."""
    names = id_names(path)[1]
    return " ".join([names[i] for i in ids]) if names else chunk_cache(path).tokenizer.decode(ids, skip_special_tokens=False)


def slices(items: list, most: int):
    for i in range(0, len(items), most):
        yield items[i : i + most]
