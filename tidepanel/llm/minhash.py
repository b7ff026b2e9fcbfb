"""Operator 10: near-duplicate groups by b-bit MinHash.

A document's shingle set gives one minimum for each of ``bands * rows`` hash functions. Bands of ``rows``
minima give candidate buckets. Of every minimum only the low bits are kept, packed into 64-bit words;
two signatures are compared by XOR and bit counts, and the share of equal lanes, corrected for lanes
that agree by chance, estimates the similarity. Candidates that the estimate does not rule out are
confirmed on the full shingle sets.

No group is ever expanded into rows of pairs. Buckets of a few members are paired by a join. Larger ones
are cut into blocks: each block compares its members with each other and with the bucket's leader, and
only members that this leaves apart from the leader are compared with all other blocks. What estimates
connect is a *group*; full sets are compared inside groups in the same way, so that no link that
connects different texts is lost.

Equal sets are one *class*, told by a 128-bit fingerprint of the set. Classes have numbers of their own;
ids come back only at the end, so rows that share an id and differ in text are never taken for each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import column_list, discard, materialize, slices
from tidepanel.llm.graph import connected_components

BATCH_BYTES = 1 << 20
#: Text hashes up to which the set of documents to confirm is broadcast (8 bytes each); beyond it is shuffled.
BROADCAST_HASHES = 500_000
#: Members up to which a bucket's pairs are joined; larger buckets are compared in blocks.
FEW = 6
#: Members and bytes of text of a block.
BLOCK = 512
BLOCK_BYTES = 4 << 20


@dataclass(frozen=True)
class MinHashPlan:
    """At a similarity of 0.8, a pair shares no bucket with probability (1 - 0.8**rows) ** bands: 4e-7."""

    shingle: int = 5
    percent: int = 80
    bands: int = 28
    rows: int = 4
    bits: int = 4
    #: Standard deviations by which an estimate may fall short.
    slack: float = 5.0
    seed: int = 20_240_229

    @property
    def lanes(self) -> int:
        return self.bands * self.rows

    @property
    def words(self) -> int:
        return -(-self.lanes * self.bits // 64)

    @property
    def least_equal(self) -> int:
        """Equal lanes under which a pair is ruled out: the expectation at the threshold less the slack."""
        chance = 2.0**-self.bits
        share = self.percent / 100
        expected = share + (1 - share) * chance
        return int(self.lanes * expected - self.slack * (self.lanes * expected * (1 - expected)) ** 0.5)


_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased; other letters stay as they are."""
    return text.encode().lower().split() if text else []


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """Sorted distinct 64-bit fingerprints of the k-word shingles; fewer words count as one shingle."""
    from xxhash import xxh3_64_intdigest

    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    width = min(k, len(words))
    acc = h[: len(words) - width + 1].copy()
    for j in range(1, width):
        acc = _mixed(acc * _ODD + h[j : len(words) - width + 1 + j])
    return np.unique(acc)


def _functions(plan: MinHashPlan) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(plan.seed)
    flips = rng.integers(0, 1 << 64, plan.lanes, dtype=np.uint64)
    factors = rng.integers(0, 1 << 64, plan.lanes, dtype=np.uint64) | np.uint64(1)
    return flips, factors


def minima(sets: list[np.ndarray], plan: MinHashPlan) -> np.ndarray:
    """(set, lane) minima of non-empty sets."""
    flips, factors = _functions(plan)
    joined = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), plan.lanes), dtype=np.uint64)
    for i in range(plan.lanes):
        out[:, i] = np.minimum.reduceat((joined ^ flips[i]) * factors[i], starts)
    return out


def band_keys(least: np.ndarray, plan: MinHashPlan) -> np.ndarray:
    """One 64-bit bucket key for each band; the band's number is part of it."""
    keys = np.empty((len(least), plan.bands), dtype=np.uint64)
    for b in range(plan.bands):
        key = np.full(len(least), b + 1, dtype=np.uint64)
        for r in range(plan.rows):
            key = _mixed(key * _ODD + least[:, b * plan.rows + r])
        keys[:, b] = key
    return keys


def packed_bits(least: np.ndarray, plan: MinHashPlan) -> np.ndarray:
    """The low bits of the minima, packed into 64-bit words."""
    per = 64 // plan.bits
    low = least & np.uint64((1 << plan.bits) - 1)
    out = np.zeros((len(least), plan.words), dtype=np.uint64)
    for i in range(plan.lanes):
        out[:, i // per] |= low[:, i] << np.uint64(i % per * plan.bits)
    return out


def signatures(docs: DataFrame, plan: MinHashPlan, id_col: str, text_col: str) -> DataFrame:
    """id, ``h`` (hash of the text), ``n_shingles``, ``f1``, ``f2`` (128-bit fingerprint of the set; null: no words), ``bands``, ``sig``."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for whole in batches:
            for batch in slices(whole, "text", BATCH_BYTES):
                sets = [shingle_hashes(text_words(t), plan.shingle) for t in column_list(batch, "text")]
                full = [i for i, s in enumerate(sets) if len(s)]
                f1, f2, bands, sig = ([None] * len(sets) for _ in range(4))
                if full:
                    least = minima([sets[i] for i in full], plan)
                    keys, bits = band_keys(least, plan).view(np.int64), packed_bits(least, plan).view(np.int64)
                    for row, i in enumerate(full):
                        a, b = np.frombuffer(xxh3_128_digest(sets[i].tobytes()), dtype=np.int64)
                        f1[i], f2[i], bands[i], sig[i] = int(a), int(b), keys[row], bits[row]
                arrays = [batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sig, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "h", "n_shingles", "f1", "f2", "bands", "sig"])

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("h"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, h long, n_shingles long, f1 long, f2 long, bands array<long>, sig array<long>")


def equal_lanes(a: Column, b: Column, plan: MinHashPlan) -> Column:
    """How many lanes of two packed signatures agree, by XOR, folding and bit counts."""
    ones = sum(1 << i for i in range(0, 64, plan.bits))
    ones -= 1 << 64 if ones >= 1 << 63 else 0
    differ = F.lit(0)
    for w in range(plan.words):
        x = F.get(a, F.lit(w)).bitwiseXOR(F.get(b, F.lit(w)))
        step = 1
        while step < plan.bits:
            x = x.bitwiseOR(F.shiftrightunsigned(x, step))
            step *= 2
        differ = differ + F.bit_count(x.bitwiseAND(F.lit(ones)))
    return F.lit(plan.lanes) - differ


def spanning(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of ``n`` members the smallest member that the links (i, j) connect it with."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, i, label[j])
        np.minimum.at(label, j, label[i])
        label = label[label]
        if (label == before).all():
            return label


def estimated_pairs(sig: np.ndarray, first: int, plan: MinHashPlan) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of signatures with enough equal lanes: inside all rows if ``first`` is 0, otherwise of the
    first ``first`` rows with the others."""
    ones = np.uint64(sum(1 << i for i in range(0, 64, plan.bits)))
    left, right = (sig, sig) if first == 0 else (sig[:first], sig[first:])
    differ = np.zeros((len(left), len(right)), dtype=np.int32)
    for w in range(plan.words):
        x = left[:, w, None] ^ right[None, :, w]
        step = 1
        while step < plan.bits:
            x |= x >> np.uint64(step)
            step *= 2
        differ += np.bitwise_count(x & ones)
    i, j = np.nonzero(plan.lanes - differ >= plan.least_equal)
    return (i[i < j], j[i < j]) if first == 0 else (i, j + first)


def exact_pairs(sets: list[np.ndarray], first: int, plan: MinHashPlan) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs by full sets, found through the members that hold each shingle; ``first`` as above."""
    sizes = np.array([len(x) for x in sets])
    if len(sets) == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        linked = 100 * both >= plan.percent * (sizes.sum() - both)
        return (np.array([0]), np.array([1])) if linked else (np.empty(0, int), np.empty(0, int))
    _, place = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(place, kind="stable")
    holders, ends = owner[order], np.cumsum(np.bincount(place))
    starts, at = ends - np.diff(ends, prepend=0), np.cumsum(sizes) - sizes
    out_i, out_j = [], []
    for i in range(first or len(sets)):
        mine = place[at[i] : at[i] + sizes[i]]
        counts = np.zeros(len(sets), dtype=np.int64)
        # the holders of each shingle, run by run, as one list of positions
        length = ends[mine] - starts[mine]
        positions = np.repeat(starts[mine] - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
        counts += np.bincount(holders[positions], minlength=len(sets))
        hit = np.flatnonzero(100 * counts >= plan.percent * (sizes[i] + sizes - counts))
        hit = hit[hit >= first] if first else hit[hit > i]
        out_i.append(np.full(len(hit), i))
        out_j.append(hit)
    return np.concatenate(out_i), np.concatenate(out_j)


def _spans(rows: DataFrame, load, find) -> DataFrame:
    """(key, lead, n, blks, id, comp) from rows (key, lead, n, blks, members): what links inside a row connect.

    ``comp`` is the smallest id that the linked pairs of a row's members connect an id with.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                members = batch.column(4)[k].values
                order = np.argsort(members.field("id").to_numpy(), kind="stable")
                members = members.take(pa.array(order))
                ids = members.field("id").to_numpy()
                comp = ids[spanning(len(ids), *find(load([members]), 0))]
                same = [pa.array(np.full(len(ids), batch.column(c)[k].as_py()), pa.int64()) for c in range(4)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(ids, pa.int64()), pa.array(comp, pa.int64())], ["key", "lead", "n", "blks", "id", "comp"])

    return rows.select("key", "lead", "n", "blks", "members").mapInArrow(run, "key long, lead long, n long, blks long, id long, comp long")


def _links_across(pairs: DataFrame, load, find) -> DataFrame:
    """Links (a, b) from rows (members, others): what linked pairs of a member and another connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                mine, others = (batch.column(c)[k].values for c in (0, 1))
                ids = np.concatenate([mine.field("id").to_numpy(), others.field("id").to_numpy()])
                label = spanning(len(ids), *find(load([mine, others]), len(mine)))
                moved = np.flatnonzero(label != np.arange(len(ids)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[moved], pa.int64()), pa.array(ids[label[moved]], pa.int64())], ["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def links_inside(rows: DataFrame, load, find) -> DataFrame:
    """Links (a, b) that connect whatever the linked pairs of one ``key`` connect.

    ``rows``: key, ``lead`` (the smallest id of the key), ``n`` (its members), ``blks`` (blocks to cut it
    into), id, value. ``load`` reads the values of lists of members, ``find`` their linked pairs.

    Every block holds the leader besides its own members. Members connected with it in their blocks are
    connected with each other; the rest meets all blocks of its key, block by block.
    """
    own = F.array(F.pmod(F.xxhash64("id"), F.col("blks")))
    led = rows.withColumn("blk", F.explode(F.when(F.col("id") == F.col("lead"), F.sequence(F.lit(0).cast("long"), F.col("blks") - 1)).otherwise(own)))
    packs = materialize(led.groupBy("key", "lead", "n", "blks", "blk").agg(F.collect_list(F.struct("id", "value")).alias("members")), "packs")
    first = materialize(_spans(packs, load, find), "spans")
    near = first.where("id != comp").select(F.col("id").alias("a"), F.col("comp").alias("b"))
    apart = first.where("comp != lead and blks > 1").select("key", "id")
    if apart.isEmpty():
        discard(packs)
        return near
    # as many members to a block as in the blocks of all
    count = apart.groupBy("key").agg(F.count(F.lit(1)).alias("r"))
    left = packs.select("key", "n", "blks", F.inline("members")).join(apart, ["key", "id"]).join(count.repartition("key"), "key")
    left = left.withColumn("own", F.pmod(F.xxhash64("id"), F.ceil(F.col("r") * F.col("blks") / F.col("n")).cast("long")))
    left = left.groupBy("key", "own", "blks").agg(F.collect_list(F.struct("id", "value")).alias("members"))
    left = left.withColumn("blk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blks") - 1)))
    right = packs.select("key", "blk", F.col("members").alias("others"))
    return near.unionByName(_links_across(left.join(right, ["key", "blk"]).select("members", "others"), load, find))


def _buckets(classes: DataFrame) -> DataFrame:
    """(bucket, id, n, lead) of the buckets that hold several classes."""
    buckets = classes.select("id", F.explode("bands").alias("bucket"))
    counted = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("lead")).where("n > 1")
    # the join reads two plain exchanges, so that a bucket with a large share of all rows can be split
    return buckets.join(counted.repartition("bucket"), "bucket")


def estimated_links(shared: DataFrame, sig: DataFrame, plan: MinHashPlan) -> DataFrame:
    """Links that connect whatever candidate pairs connect whose estimate does not rule them out."""
    few = shared.where(F.col("n") <= FEW).select("bucket", "id")
    pairs = few.select("bucket", F.col("id").alias("a")).join(few.select("bucket", F.col("id").alias("b")), "bucket").where("a > b").select("a", "b").distinct()
    pairs = pairs.join(sig.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a").join(sig.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b")
    small = pairs.where(equal_lanes(F.col("sa"), F.col("sb"), plan) >= plan.least_equal).select("a", "b")
    blks = F.ceil(F.col("n") / BLOCK).cast("long")
    many = shared.where(F.col("n") > FEW).select(F.col("bucket").alias("key"), "lead", "n", blks.alias("blks"), "id").join(sig.select("id", F.col("sig").alias("value")), "id")

    def load(parts):
        return np.concatenate([p.field("value").flatten().to_numpy(zero_copy_only=False) for p in parts]).view(np.uint64).reshape(-1, plan.words)

    return small.unionByName(links_inside(many, load, lambda values, first: estimated_pairs(values, first, plan)))


def exact_links(groups: DataFrame, texts: DataFrame, plan: MinHashPlan) -> DataFrame:
    """Links that connect whatever pairs inside a group (node, component) are linked by their full sets."""
    rows = groups.select(F.col("node").alias("id"), F.col("component").alias("key")).join(texts, "id")
    sizes = rows.groupBy("key").agg(F.sum("size").cast("long").alias("bytes"), F.count(F.lit(1)).alias("n"))
    blks = F.greatest(F.ceil(F.col("bytes") / BLOCK_BYTES), F.ceil(F.col("n") / BLOCK), F.lit(1)).cast("long")
    rows = rows.join(sizes.select("key", "n", blks.alias("blks")).repartition("key"), "key")

    def load(parts):
        return [shingle_hashes(text_words(t), plan.shingle) for p in parts for t in p.field("value").to_pylist()]

    return links_inside(rows.select("key", F.col("key").alias("lead"), "n", "blks", "id", "value"), load, lambda values, first: exact_pairs(values, first, plan))


def _judged(docs: DataFrame, plan: MinHashPlan, id_col: str, text_col: str) -> DataFrame:
    """id, ``h`` (hash of the text), ``n_shingles``, ``component`` (null for a null id), ``kept`` of every row."""
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("h"), F.col(text_col).alias("text"))
    sigs = materialize(signatures(docs, plan, id_col, text_col), "signatures")
    # any row of a class has its bands and signature; the smallest id and its text stand for it
    classes = sigs.where("f1 is not null and id is not null").groupBy("f1", "f2").agg(F.min(F.struct("id", "h")).alias("m"), F.count(F.lit(1)).alias("rows"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("cls"), "f1", "f2", "m.id", "m.h", "rows", "bands", "sig"), "classes")
    numbered = classes.select(F.col("cls").alias("id"), "bands", "sig")
    shared = materialize(_buckets(numbered), "buckets")
    groups = materialize(connected_components(estimated_links(shared, numbered.select("id", "sig"), plan)), "groups")
    discard(shared)
    needed = groups.join(classes, groups["node"] == classes["cls"]).select("cls", "id", "h")
    if groups.count() <= BROADCAST_HASHES:
        source = source.join(F.broadcast(needed.select("h").distinct()), "h", "left_semi")
    texts = source.join(needed, ["id", "h"]).groupBy("cls").agg(F.first("text").alias("value"))
    texts = materialize(texts.select(F.col("cls").alias("id"), "value", F.octet_length("value").alias("size")), "texts")
    labels = materialize(connected_components(exact_links(groups, texts, plan)), "labels")
    discard(texts)
    # the smallest id of each component's classes
    named = labels.join(classes.select(F.col("cls").alias("node"), "id"), "node")
    least = named.groupBy("component").agg(F.min("id").alias("least"))
    placed = labels.join(least.repartition("component"), "component").select(F.col("node").alias("cls"), "least")
    grouped = classes.select("cls", "f1", "f2", "id", "rows").join(placed, "cls", "left").where("least is not null or rows > 1")
    grouped = materialize(grouped.select("f1", "f2", F.coalesce("least", "id").alias("comp")), "grouped")
    out = sigs.select("id", "h", "n_shingles", "f1", "f2").join(grouped, ["f1", "f2"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("comp", "id"))
    return out.select("id", "h", "n_shingles", component.alias("component")).withColumn("kept", F.coalesce(F.col("id") == F.col("component"), F.lit(True)))


def near_duplicates(docs: DataFrame, plan: MinHashPlan = MinHashPlan(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``n_shingles``, ``component_id``, ``kept`` for every row.

    ``component_id`` is the smallest id that links reach (``percent`` or more of the union shared), the
    row's own included; ``kept`` marks the rows whose id that is. Rows without words (null, empty or
    white space only) are linked with nothing. Ids must have an order. Rows that repeat an id are
    linked by their own texts, each on its own; a null id is linked with nothing, has a null component and
    is kept. Other columns are not read. An empty table gives an empty result.
    """
    return _judged(docs, plan, id_col, text_col).select(F.col("id").alias(id_col), "n_shingles", F.col("component").alias("component_id"), "kept")


def drop_near_duplicates(docs: DataFrame, plan: MinHashPlan = MinHashPlan(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, with all columns; of rows equal in id and text, one.

    Rows are told by id and text, so a text goes only for its own links, whatever else its id names. Rows
    without an id stay. No column is added on the way, so none can clash.
    """
    gone = _judged(docs, plan, id_col, text_col).where(~F.col("kept")).select(F.col("id").alias("gone_id"), F.col("h").alias("gone_h")).distinct()
    gone = materialize(gone, "gone")
    own_id, own_text = docs[f"`{id_col}`"], docs[f"`{text_col}`"]
    left = docs.join(gone, (own_id == gone["gone_id"]) & (F.xxhash64(own_text) == gone["gone_h"]), "left_anti")
    named = left.where(F.col(f"`{id_col}`").isNotNull()).dropDuplicates([id_col, text_col])
    return named.unionByName(left.where(F.col(f"`{id_col}`").isNull()))
