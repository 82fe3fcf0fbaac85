"""Near-duplicate documents by circulant MinHash, with every link confirmed on full shingle sets.

Two permutations of the 32-bit universe make all signature coordinates: ``sigma`` spreads a
shingle, ``pi`` ranks it, and coordinate ``k`` ranks the universe shifted around by ``k``.
``rows`` coordinates form a band: 24 bands of 5 miss a pair at 0.85 with a chance below 1e-6, 32
miss one at 0.8 with a chance below 4e-6.

Equal sets are one class from the start. Classes that share a band are candidates. Buckets of up
to ``SMALL`` members are compared pairwise; larger ones are merged where one document is the
medoid of several, and never turned into all their pairs. Of such a bucket a centre is drawn, the
shingles that most of a few members hold, and each member is kept as what it differs in from
the centre: two members differ in just what these differences differ in, so all that
follows is exact without their texts. The member with the most slack (it is allowed more
differences than it has) is compared with all others, and all links found so far are made into
components: only members of different components are compared further. Buckets of up to
``BLOCKED`` members are then compared whole, in pairs of blocks of ``SIDE`` members, so that a member is
copied once a block. In larger ones two members can be linked only if both share a number of
differences that their sizes tell, hence one of their rarest. Those that share one make a bucket
again, once for each set of members: small ones are compared by pairs, larger ones in blocks, and
those beyond ``BLOCKED`` go through the next round. If these buckets would hold more rows than the blocks
of the one they come from, that one is compared in blocks. Nothing is capped.

Sets are kept as 64-bit hashes of shingles, so links are exact up to their collisions.

Defined results: null and empty texts, and texts without words, have an empty set and are linked
with nothing. Fewer words than a shingle make one shingle. Rows that share an id are one
document (of different texts, one is compared). A null id is linked with nothing and its row is
kept. No rows in, no rows out. Columns other than the id and the text don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, id_and_text, named
from .superkmers import Words, grams, mixed

SMALL, DRAWN, BLOCK = 4, 24, 1 << 16
#: Members of a bucket that is compared in blocks at once, members of a block and elements of its differences.
BLOCKED, SIDE, WEIGHT = 2048, 256, 1 << 18
SIGNED = "doc_id long, n_shingles long, digest binary, bands array<long>"
VERIFIED = "rep long, member long, n_rep long, n_member long, n_both long"
LINKS = "rep long, member long"
DIFFERING = "key long, id long, n long, d array<long>"


def shingles(text: bytes, words: int) -> np.ndarray:
    """The sorted set of a text's shingle hashes; the whole sequence where it is shorter."""
    hashes, _, _ = Words().cut(b" ".join(text.lower().split()))
    size = min(words, len(hashes))
    return np.unique(mixed(grams(hashes, size) + np.uint64(size))) if size else hashes


def permuted(x: np.ndarray, first: int, second: int) -> np.ndarray:
    """A permutation of the 32-bit numbers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(first)
    x ^= x >> np.uint32(13)
    x *= np.uint32(second)
    x ^= x >> np.uint32(16)
    return x


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """One row for each set, none of which is empty."""
    starts = np.cumsum([0, *map(len, sets[:-1])])
    spread = permuted(np.concatenate(sets).astype(np.uint32), 0x85EBCA6B, 0xC2B2AE35)
    out = np.empty((len(sets), coordinates), np.uint32)
    for k in range(coordinates):
        out[:, k] = np.minimum.reduceat(permuted(spread - np.uint32(k), 0x7FEB352D, 0x846CA68B), starts)
    return out


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    parts = signature.reshape(len(signature), bands, -1).astype(np.uint64)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), parts.shape[:2])
    for column in range(parts.shape[2]):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, column] + np.uint64(1))
    return key.view(np.int64)


def blocks(sets: list[np.ndarray]) -> Iterator[list[int]]:
    """Numbers of the sets that aren't empty, together about BLOCK shingles at a time."""
    some, size = [], 0
    for i, s in enumerate(sets):
        if len(s):
            some.append(i)
            size += len(s)
        if size >= BLOCK:
            yield some
            some, size = [], 0
    if some:
        yield some


def signed(docs: DataFrame, words: int, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                sets = [shingles(t, words) for t in batch.column(1).to_pylist()]
                keys: list = [None] * len(sets)
                for some in blocks(sets):
                    for i, own in zip(some, band_keys(signatures([sets[i] for i in some], bands * rows), bands), strict=True):
                        keys[i] = own
                sizes = [len(s) for s in sets]
                digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "digest", "bands"])

    texts = id_and_text(docs, id_col, text_col)
    return texts.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, SIGNED)


def squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=1)
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([squeeze.compress(b" ".join(t.lower().split())) for t in batch.column(1).to_pylist()], pa.binary())], ["id", "packed"])


def verify(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """Set sizes of every pair (rep, member)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unsqueeze = zstandard.ZstdDecompressor()
        held: tuple = (None, None)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                out: list[list] = [[] for _ in range(5)]
                for rep, member, of_rep, of_member in zip(*(c.to_pylist() for c in whole.slice(at, 256).columns), strict=True):
                    if held[0] != of_rep:
                        held = of_rep, shingles(unsqueeze.decompress(of_rep), words)
                    a, b = held[1], shingles(unsqueeze.decompress(of_member), words)
                    for column, value in zip(out, (rep, member, len(a), len(b), len(np.intersect1d(a, b, assume_unique=True))), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], [x.split()[0] for x in VERIFIED.split(", ")])

    of_member = texts.select(F.col("id").alias("member"), F.col("packed").alias("of_member"))
    of_rep = texts.select(F.col("id").alias("rep"), F.col("packed").alias("of_rep"))
    return pairs.join(of_member, "member").join(of_rep, "rep").select("rep", "member", "of_rep", "of_member").mapInArrow(run, VERIFIED)


def drawn(key: str = "key", size: str = "n") -> Column:
    """About ``DRAWN`` members of every bucket of ``size``, all of a small one, by hash."""
    return F.pmod(F.xxhash64(key, "id"), F.col(size)) < DRAWN


def differences(members: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """(key, id, n, d): a member's set size and what it differs in from the centre of its bucket; members: (key, id, n)."""

    def centre(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unsqueeze, squeeze = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for at in range(batch.num_rows):
                sets = [shingles(unsqueeze.decompress(p), words) for p in batch.column(1)[at].as_py()]
                found, times = np.unique(np.concatenate(sets), return_counts=True)
                packed = squeeze.compress(found[2 * times > len(sets)].tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 1), pa.array([packed], pa.binary())], ["key", "centre"])

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unsqueeze = zstandard.ZstdDecompressor()
        held: tuple = (None, np.zeros(0, np.uint64))
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                sizes, lists = [], []
                for packed, centre in zip(batch.column("packed").to_pylist(), batch.column("centre").to_pylist(), strict=True):
                    if centre is not None and held[0] != centre:
                        held = centre, np.frombuffer(unsqueeze.decompress(centre), np.uint64)
                    own = shingles(unsqueeze.decompress(packed), words)
                    sizes.append(len(own))
                    lists.append((own if centre is None else np.setxor1d(own, held[1], assume_unique=True)).view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("id"), pa.array(sizes, pa.int64()), pa.array(lists, pa.list_(pa.int64()))], ["key", "id", "n", "d"])

    some = members.where(drawn()).select("key", "id").join(texts, "id").groupBy("key").agg(F.collect_list("packed").alias("packs"))
    centres = some.mapInArrow(centre, "key long, centre binary")
    return members.select("key", "id").join(texts, "id").join(centres, "key", "left").select("key", "id", "packed", "centre").mapInArrow(differ, DIFFERING)


def recentred(rows: DataFrame) -> DataFrame:
    """Rows (key, id, n, d) with differences from a centre of their bucket's differences: what most of a few members have."""
    sizes = rows.groupBy("key").agg(F.count("*").alias("members"))
    some = rows.join(sizes, "key").where(drawn(size="members")).select("key", "d")
    half = some.groupBy("key").agg((F.count("*") / 2).alias("half"))
    times = some.select("key", F.explode("d").alias("e")).groupBy("key", "e").agg(F.count("*").alias("times"))
    centres = times.join(half, "key").where("times > half").groupBy("key").agg(F.collect_list("e").alias("centre"))
    new = F.when(F.col("centre").isNull(), F.col("d")).otherwise(F.concat(F.array_except("d", "centre"), F.array_except("centre", "d")))
    return rows.join(centres, "key", "left").select("key", "id", "n", new.alias("d"))


def buckets(members: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """All pairs (rep, member) of small buckets in (key, id); (key, id, n) of large ones, merged by medoid, if there are any."""
    score = members.groupBy("id").agg(F.sum("n").alias("score"))
    few = members.where(F.col("n") <= SMALL).groupBy("key").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    pairs = few.select(F.explode(F.flatten(F.transform("ids", lambda a: F.transform(F.filter("ids", lambda b: b > a), lambda b: F.struct(a.alias("rep"), b.alias("member")))))).alias("p"))
    pairs = pairs.select("p.rep", "p.member").distinct()
    large = members.where(F.col("n") > SMALL)
    if large.isEmpty():
        return pairs, None
    medoids = large.join(score, "id").groupBy("key").agg(F.max_by("id", F.struct("score", -F.col("id"))).alias("medoid"))
    merged = checkpointed(large.join(medoids, "key").select(F.col("medoid").alias("key"), "id").distinct())
    sizes = merged.groupBy("key").agg(F.count("*").alias("n"))
    return pairs, merged.join(sizes, "key")


def rarest_shared(left: DataFrame) -> DataFrame:
    """(key, e, id, failed, close): which of their rarest differences members show, where another has them.

    ``left`` has (key, id, failed, close, wide, d). A member shows its ``size(d) + wide`` rarest ones to
    linked members if it failed, else to failed ones; ``size(d) + close`` of these to failed ones
    (``close``), which is fewer as two failed members must share more.
    """
    elements = left.select("key", "id", "failed", "close", "wide", F.explode("d").alias("e"))
    several = elements.groupBy("key", "e").agg(F.count("*").alias("held")).where("held > 1")
    by_rarity = F.array_sort(F.collect_list(F.struct("held", "e")))["e"].alias("shared")
    ranked = elements.join(several, ["key", "e"]).groupBy("key", "id").agg(by_rarity, *[F.first(c).alias(c) for c in ("failed", "close", "wide")])
    ranked = ranked.withColumn("shown", (F.size("shared") + F.col("wide")).cast("int")).where("shown > 0")  # those that only one has come first
    return ranked.select("key", "id", "failed", (F.size("shared") + F.col("close")).alias("of_close"), F.posexplode(F.slice("shared", F.lit(1), F.col("shown"))).alias("place", "e")).select(
        "key", "e", "id", "failed", (F.col("place") < F.col("of_close")).alias("close")
    )


def spanning(m: int, links: np.ndarray, component: np.ndarray) -> list[tuple[int, int]]:
    """Of links (two columns of row numbers) as many as connect what they connect, but for what is connected already."""
    pairs = component[links]
    pairs.sort(axis=1)
    firsts = np.unique(pairs, axis=0, return_index=True)[1]
    label: dict[int, int] = {}
    out = []
    for a, b in links[firsts].tolist():
        x, y = int(component[a]), int(component[b])
        while (z := label.get(x, x)) != x:
            x = z
        while (z := label.get(y, y)) != y:
            y = z
        if x != y:
            label[x] = y
            out.append((a, b))
    return out


def compare_block(table: pa.Table, far: int) -> pa.Table:
    """Links that connect members of one pair of blocks: id, component, slack, d."""
    ids, component, slack = (table.column(c).to_numpy() for c in ("id", "component", "slack"))
    lists, m = table.column("d").combine_chunks(), table.num_rows
    value = lists.flatten().to_numpy()
    row = np.repeat(np.arange(m), lists.value_lengths().to_numpy(zero_copy_only=False))
    order = np.argsort(value, kind="stable")
    value, row = value[order], row[order]
    shared = np.zeros(m * m, np.int64)
    for apart in range(1, m):  # members that share a value stand next to each other, in order
        same = value[apart:] == value[:-apart]
        if not same.any():
            break
        shared += np.bincount(row[:-apart][same] * m + row[apart:][same], minlength=m * m)
    shared = shared.reshape(m, m)
    linked = (slack[:, None] + slack + 2 * far * (shared + shared.T) >= 0) & (component[:, None] != component)
    found = spanning(m, np.argwhere(np.triu(linked, 1)), component)
    a, b = (np.array(x, np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
    return pa.table({"rep": ids[a], "member": ids[b]})


def by_component(rows: DataFrame) -> DataFrame:
    """Of each bucket of (key, id, component, d): its members, those of its largest component, and the elements of both."""
    of = rows.groupBy("key", "component").agg(F.count("*").alias("c"), F.sum(F.size("d")).alias("w"))
    largest = F.max_by(F.struct("component", "c", "w"), F.struct("c", "component")).alias("largest")
    return of.groupBy("key").agg(F.sum("c").alias("m"), F.sum("w").alias("weight"), largest)


def blocks_of(many: Column, weight: Column) -> Column:
    return F.ceil(F.greatest(many / SIDE, weight / WEIGHT)).cast("int")


def in_blocks(rows: DataFrame, percent: int) -> DataFrame:
    """Links (rep, member) that connect different components of a bucket: (key, id, slack, component, d).

    Each member outside of the bucket's largest component meets every other one, in blocks of about
    ``SIDE`` members, so a member is copied once for each such block, not for each partner.
    """
    rows = rows.select("key", "id", "slack", "component", "d")
    rows = rows.join(by_component(rows), "key").where("largest.c < m")
    one = (F.col("m") <= SIDE) & (F.col("weight") <= WEIGHT)
    other = one | (F.col("component") != F.col("largest.component"))
    few = F.when(one, 1).otherwise(blocks_of(F.col("m") - F.col("largest.c"), F.col("weight") - F.col("largest.w")))
    rest = F.when(one, 0).otherwise(blocks_of(F.col("largest.c"), F.col("largest.w")))
    rows = rows.select("key", "id", "slack", "component", "d", other.alias("other"), few.alias("few"), rest.alias("rest"))
    own = F.when(F.col("other"), F.pmod(F.xxhash64("id"), F.col("few"))).otherwise(F.col("few") + F.pmod(F.xxhash64("id"), F.greatest("rest", F.lit(1)))).cast("int")
    met = F.sequence(F.lit(0), F.when(F.col("other"), F.col("few") + F.col("rest") - 1).otherwise(F.col("few") - 1))
    placed = rows.withColumn("own", own).withColumn("met", F.explode(met))
    placed = placed.select("key", F.least("own", "met").alias("a"), F.greatest("own", "met").alias("b"), "id", "slack", "component", "d")
    far = 100 + percent
    return placed.groupBy("key", "a", "b").applyInArrow(lambda table: compare_block(table, far), LINKS)


def compared(rows: DataFrame, percent: int, known: DataFrame | None = None) -> tuple[list[DataFrame], DataFrame | None]:
    """Links found in buckets of (key, id, n, d), and the rows of the next round; ``known``: links found before.

    Sets of n1 and n2 shingles that differ from the centre in d1 and d2, c of them shared, are linked if
    slack1 + slack2 + 2 * (100 + p) * c >= 0, where slack = (100 - p) * n - (100 + p) * d. So c must
    reach a number that the slacks tell, and one of the rarest d1 - c + 1 differences must be shared.
    Members that links found so far connect are of one component and aren't compared again.
    """
    far, near = 100 + percent, 100 - percent
    linked = lambda a, b, x, y: a + b + 2 * far * F.size(F.array_intersect(x, y)) >= 0
    rows = rows.withColumn("slack", near * F.col("n") - far * F.size("d"))
    best = rows.groupBy("key").agg(F.max_by(F.struct("id", "d", "slack"), F.struct("slack", -F.col("id"))).alias("rep"))
    near_rep = linked(F.col("slack"), F.col("rep.slack"), F.col("d"), F.col("rep.d"))
    seen = checkpointed(rows.join(best, "key").where("id != rep.id").select("key", "id", "n", "d", "slack", F.col("rep.id").alias("rep"), (~near_rep).alias("failed")))
    found = [seen.where("not failed").select("rep", F.col("id").alias("member"))]
    limits = seen.groupBy("key").agg(F.max(F.when(F.col("failed"), F.col("slack"))).alias("of_failed"), F.max(F.when(~F.col("failed"), F.col("slack"))).alias("of_linked")).where("of_failed is not null")
    spare = lambda other: 1 - F.greatest(F.lit(1), F.ceil(-(F.col("slack") + other) / (2 * far)))
    close = spare(F.col("of_failed"))
    wide = F.when(F.col("failed") & F.col("of_linked").isNotNull(), spare(F.col("of_linked"))).otherwise(close)
    left = seen.join(limits, "key").select("key", "id", "n", "d", "slack", "failed", close.alias("close"), F.greatest(close, wide).alias("wide"))
    left = left.where(F.size("d") + F.col("wide") > 0)
    if left.isEmpty():
        return found, None
    label = components(reduce(DataFrame.unionByName, found if known is None else [known, *found]))
    left = left.join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
    left = checkpointed(left.join(by_component(left).where("largest.c < m"), "key"))
    found.append(checkpointed(in_blocks(left.where(F.col("m") <= BLOCKED), percent)))
    large = left.where(F.col("m") > BLOCKED)
    if large.isEmpty():
        return found, None
    shown = rarest_shared(large).join(large.select("key", "id", "component"), ["key", "id"])
    # one bucket for each set of members that show an element, if it has different components
    alike = shown.groupBy("key", "e").agg(F.count("*").alias("held"), F.min("component").alias("low"), F.max("component").alias("high"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("y"))
    alike = alike.where("low < high").groupBy("held", "x", "y").agg(F.min(F.struct("key", "e")).alias("at")).select("at.*", "held", F.xxhash64("held", "x", "y").alias("next"))
    shown = checkpointed(shown.join(alike, ["key", "e"]).select("key", "id", "component", "held", "next"))
    # where these would hold more rows than the bucket in blocks, take the blocks
    other, g = F.col("m") - F.col("largest.c"), F.col("largest.c")
    cost = other * blocks_of(F.col("m"), F.col("weight")) + g * blocks_of(other, F.col("weight") - F.col("largest.w"))
    dear = shown.groupBy("key").agg(F.count("*").alias("rows")).join(by_component(large), "key").where(F.col("rows") >= cost).select("key")
    found.append(checkpointed(in_blocks(large.join(dear, "key", "left_semi"), percent)))
    shown = shown.join(dear, "key", "left_anti")
    of = large.select("key", "id", "n", "slack", "component", "d")
    side = lambda c: of.select("key", F.col("id").alias(c), F.col("slack").alias(f"slack_{c}"), F.col("d").alias(f"d_{c}"))
    few = shown.where(F.col("held") <= 2 * SMALL).groupBy("key", "next").agg(F.collect_list(F.struct("id", "component")).alias("ids"))
    pairs = few.select("key", F.explode("ids").alias("one"), "ids").select("key", "one", F.explode("ids").alias("two")).where("one.id < two.id and one.component != two.component")
    pairs = pairs.select("key", F.col("one.id").alias("a"), F.col("two.id").alias("b")).groupBy("a", "b").agg(F.min("key").alias("key"))
    both = pairs.join(side("a"), ["key", "a"]).join(side("b"), ["key", "b"])
    found.append(checkpointed(both.where(linked(F.col("slack_a"), F.col("slack_b"), F.col("d_a"), F.col("d_b"))).select(F.col("a").alias("rep"), F.col("b").alias("member"))))
    more = shown.where(F.col("held") > 2 * SMALL).select("key", "id", "held", "next").join(of, ["key", "id"]).withColumn("key", F.col("next"))
    found.append(checkpointed(in_blocks(more.where(F.col("held") <= BLOCKED), percent)))
    more = checkpointed(more.where(F.col("held") > BLOCKED).select("key", "id", "n", "d"))
    return found, None if more.isEmpty() else more


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in the edges (rep, member): the smallest id it can reach."""
    both = edges.select(F.col("rep").alias("id"), F.col("member").alias("other")).unionByName(edges.select(F.col("member").alias("id"), F.col("rep").alias("other")))
    both = checkpointed(both.distinct())
    labels = both.groupBy("id").agg(F.least(F.col("id"), F.min("other")).alias("component"))
    number = 0
    while True:
        near = both.join(labels.select(F.col("id").alias("other"), F.col("component").alias("near")), "other").groupBy("id").agg(F.min("near").alias("near"))
        new = labels.join(near, "id").select("id", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        if number:  # chains: double the distance that labels have come
            jump = labels.select(F.col("id").alias("component"), F.col("component").alias("further"))
            new = new.join(jump, "component").select("id", "was", F.least("component", "further").alias("component"))
        new = checkpointed(new)
        labels = new.select("id", "component")
        if new.where("component < was").isEmpty():
            break
        number += 1
    return labels


def is_linked(percent: int) -> Column:
    return F.col("n_both") * 100 >= percent * (F.col("n_rep") + F.col("n_member") - F.col("n_both"))


def links(classes: DataFrame, docs: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> DataFrame | None:
    """Links (rep, member) enough to connect what is linked; ``classes``: (id, bands). None: no candidates."""
    bands = classes.select("id", F.explode("bands").alias("key"))
    several = bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = checkpointed(bands.join(several, "key"))
    if members.isEmpty():
        return None
    texts = id_and_text(docs, id_col, text_col).select("doc_id", F.col("text").cast("binary").alias("text"))
    texts = texts.mapInArrow(squeezed, "id long, packed binary").join(members.select("id").distinct(), "id", "left_semi")
    texts = checkpointed(texts.groupBy("id").agg(F.min("packed").alias("packed")))
    pairs, large = buckets(members)
    found = [checkpointed(verify(pairs, texts, words)).where(is_linked(percent)).select("rep", "member")]
    rows: DataFrame | None = None if large is None else checkpointed(differences(large, texts, words))
    while rows is not None:
        more, rows = compared(rows, percent, reduce(DataFrame.unionByName, found))
        found += more
        rows = rows and checkpointed(recentred(rows))
    return reduce(DataFrame.unionByName, found)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = 32, rows: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of ``docs``."""
    sets = checkpointed(signed(docs, words, bands, rows, id_col, text_col))
    classes = sets.where("doc_id is not null and digest is not null").groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands"))
    classes = checkpointed(classes)
    edges = links(classes.select("id", "bands"), docs, words, percent, id_col, text_col)
    of_class = classes.select("digest", "id")
    if edges is not None:
        known = components(edges)
        of_class = of_class.join(known, "id", "left").select("digest", F.coalesce("component", "id").alias("id"))
    out = sets.select("doc_id", "n_shingles", "digest").join(of_class, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (component.isNull() | (component == F.col("doc_id"))).alias("kept"))


def keep_one_of_each(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = 32, rows: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose document has the smallest id of its near duplicates."""
    gone = near_duplicates(docs, words, percent, bands, rows, id_col, text_col).where("not kept").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti").select(*[named(c) for c in docs.columns])
