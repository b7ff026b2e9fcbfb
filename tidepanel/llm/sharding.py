"""Operator 5: sharding by histogram sort.

Documents are ordered by the key (hash of the text, id, row number), so equal texts are neighbours. The order is cut
at equal shares of the bytes: exact byte counts below candidate boundaries are gathered over all
partitions, the intervals that hold a cut are probed more finely, and so on until every cut is within
tolerance. Only then do rows move, once, to the fragments between the cuts.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm.common import fresh, materialize, parts_for, set_aside, shuffle_partitions

#: Probes by which one interval is split in a round, as a power of two.
PROBE_BITS = 8
#: Fragments of a shard, the unit that one task sorts: as many as its bytes need, within these bounds.
FRAGMENTS, MOST_FRAGMENTS, FRAGMENT_BYTES = 8, 256, 128 << 20
#: A cut may leave its place by this share of a shard's bytes to keep equal texts together.
TOLERANCE = 0.005
#: The same for the cuts inside a shard, by a fragment's bytes.
INNER = 0.3

_BIAS = 1 << 63
#: The parts of the key, each a signed 64-bit number: hash of the text, order key of the id, number of the row.
KEY = ("high", "low", "row")


@dataclass(frozen=True)
class Cut:
    """Rows with a key below ``key`` (a beginning of the key; the rest is least) come first; exact counts of them."""

    key: tuple[int, ...]
    bytes_below: int
    rows_below: int


def key_columns(docs: DataFrame, id_col: str, text_col: str) -> dict[str, Column]:
    """``high`` (hash of the text), ``low`` (order key of the id), ``row`` and ``size``.

    An integer id is its own order key; any other id is ordered by its hash. A null id comes first.
    """
    kind = dict(docs.dtypes)[id_col]
    own = F.col(f"`{id_col}`")
    low = own.cast("long") if kind in ("bigint", "int", "smallint", "tinyint") else F.xxhash64(own)
    text = F.col(f"`{text_col}`")
    return {
        "high": F.xxhash64(F.coalesce(text, F.lit(""))),
        "low": F.coalesce(low, F.lit(-_BIAS)),
        "row": F.monotonically_increasing_id(),
        "size": F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1,
    }


def _slot(key: Column, start: int, bits: int, width: int) -> Column:
    """The sub-interval, of ``2**bits`` in an interval of ``2**width`` keys from ``start``, that holds ``key``."""
    shift = width - bits
    if width == 64:  # the whole range: the sign bit is turned so that the order is that of numbers
        return F.shiftrightunsigned(key.bitwiseXOR(F.lit(-_BIAS)), shift)
    return F.shiftrightunsigned(key - F.lit(start), shift)


def _probe(keys: DataFrame, level: int, intervals: dict[int, tuple[tuple[int, ...], int, int]]) -> dict[int, list[tuple[int, int, int]]]:
    """Exact bytes and rows in each probed sub-interval: {interval: [(slot, bytes, rows)]}.

    ``intervals``: number → (values of the parts of the key before ``level``, start, width in bits). One
    aggregation over all rows inside them; what comes back is bounded by the number of intervals times
    ``2**PROBE_BITS``.
    """
    key = F.col(KEY[level])
    which, slot = None, None
    for number, (prefix, start, width) in intervals.items():
        inside = F.lit(True) if width == 64 else key.between(start, start + (1 << width) - 1)
        for name, value in zip(KEY, prefix, strict=False):
            inside = inside & (F.col(name) == value)
        place = _slot(key, start, min(PROBE_BITS, width), width)
        which = F.when(inside, number) if which is None else which.when(inside, number)
        slot = F.when(inside, place) if slot is None else slot.when(inside, place)
    rows = keys.select(which.alias("k"), slot.cast("long").alias("s"), "size").where(F.col("k").isNotNull())
    found: dict[int, list[tuple[int, int, int]]] = {}
    for r in rows.groupBy("k", "s").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect():
        found.setdefault(r["k"], []).append((r["s"], r["b"], r["n"]))
    return {k: sorted(v) for k, v in found.items()}


def find_cuts(keys: DataFrame, parts: int, group_parts: int, tolerance: float = TOLERANCE) -> list[Cut]:
    """The ``parts - 1`` cuts that split the bytes evenly, with exact counts below each.

    Every ``group_parts``-th cut is a shard's end. A cut that meets a text's hash moves to the nearer
    end of that text's group if this costs no more than ``tolerance`` of a shard's bytes; otherwise it goes
    into the group, where ids order the rows, and inside one id, where their numbers do.
    """
    total = keys.agg(F.sum("size").alias("b")).first()["b"] or 0
    if total == 0:
        return []
    targets = [total * i // parts for i in range(1, parts)]
    # ends of shards must be close; the fragments inside a shard need not be even
    allowed = [int(total / parts * (tolerance * group_parts if i % group_parts == 0 else INNER)) for i in range(1, parts)]
    cuts: list[Cut | None] = [None] * len(targets)
    # (values of the parts before, start, width) → bytes and rows below it, cuts wanted inside
    open_at: dict[tuple[tuple[int, ...], int, int], tuple[int, int, list[int]]] = {((), -_BIAS, 64): (0, 0, list(range(len(targets))))}
    while open_at:
        after: dict[tuple[tuple[int, ...], int, int], tuple[int, int, list[int]]] = {}
        for level in range(len(KEY)):
            batch = [(k, v) for k, v in open_at.items() if len(k[0]) == level]
            for at in range(0, len(batch), 128):
                part = batch[at : at + 128]
                seen = _probe(keys, level, {n: k for n, (k, _) in enumerate(part)})
                for n, ((prefix, start, width), (below_b, below_n, wanted)) in enumerate(part):
                    step = 1 << (width - min(PROBE_BITS, width))
                    slots = seen.get(n, [])
                    sums = [(below_b, below_n)]
                    for _, b, rows in slots:
                        sums.append((sums[-1][0] + b, sums[-1][1] + rows))
                    edges = [s[0] for s in sums]
                    for i in wanted:
                        j = min(bisect_right(edges, targets[i]) - 1, len(slots) - 1)
                        left, right = sums[j], sums[j + 1]
                        low_key = start + slots[j][0] * step
                        near = min((abs(e[0] - targets[i]), c, e) for c, e in ((low_key, left), (low_key + step, right)))
                        if near[0] <= allowed[i] or slots[j][2] == 1:  # one document is never split
                            cuts[i] = Cut((*prefix, near[1]), *near[2])
                        elif step > 1:
                            after.setdefault((prefix, low_key, width - min(PROBE_BITS, width)), (*left, []))[2].append(i)
                        else:  # one value holds the cut and is too large to move it to an end
                            after.setdefault(((*prefix, low_key), -_BIAS, 64), (*left, []))[2].append(i)
        open_at = after
    return [c for c in cuts if c is not None]


def _assign(cuts: list[Cut], names: dict[str, str]) -> Column:
    """The number of cuts at or below a row's key, as a balanced tree of comparisons; ``names``: columns of its parts."""

    def below(key: tuple[int, ...], level: int = 0) -> Column:
        own, edge = F.col(names[KEY[level]]), key[0]
        if edge >= _BIAS:  # behind every value
            return F.lit(True)
        if len(key) == 1:
            return own < F.lit(edge)
        return (own < F.lit(edge)) | ((own == F.lit(edge)) & below(key[1:], level + 1))

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(below(cuts[mid].key), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(cuts))


def shard(docs: DataFrame, shards: int = 16, *, id_col: str = "doc_id", text_col: str = "text", fragments: int | None = None, tolerance: float = TOLERANCE, keep: tuple[str, ...] | None = None) -> DataFrame:
    """The columns ``keep`` (None: all) with ``size``, ``shard`` and ``slot``: shards of nearly equal bytes, in key order.

    Law ``bytes``: a shard's bytes differ from the mean by at most ``tolerance`` of a shard at either
    end, or by one document. Size: UTF-8 bytes of the text (null: none) plus 1. Equal texts stay in one
    shard unless a group is larger than the tolerance and meets a boundary; then its rows are split by id,
    and rows equal in id too (null ids, say) by a row number, so that a group of any share is spread.
    ``slot`` numbers a shard's rows from 0. Input columns that are called like an added one are renamed to
    ``input_<name>``. An empty table gives an empty result.

    The kept columns and the keys are written once to the shared folder, where row numbers are fixed and
    the keys are probed. Rows move in one exchange, which sorts each of ``shards * fragments`` fragments (None: of about
    ``FRAGMENT_BYTES``, 8 to 256 a shard); columns that the caller does not use are pruned before it.
    """
    spark = docs.sparkSession
    wanted = docs.select(*[F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)])
    named = set_aside(wanted, ("size", "shard", "slot"))
    own = {name: fresh(named, f"_{name}") for name in (*KEY, "size", "fragment")}
    keyed = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(wanted.columns, named.columns, strict=True)], *[c.alias(own[n]) for n, c in key_columns(docs, id_col, text_col).items()])
    stored = materialize(keyed, "shard-rows")
    keys = stored.select(*[F.col(own[n]).alias(n) for n in (*KEY, "size")])
    if fragments is None:
        total = keys.agg(F.sum("size").alias("n")).first()["n"] or 0
        fragments = min(max(parts_for(total, shards * FRAGMENT_BYTES), FRAGMENTS), MOST_FRAGMENTS)
    cuts = find_cuts(keys, shards * fragments, fragments, tolerance)
    first = [(0, 0)] + [(c.bytes_below, c.rows_below) for c in cuts]
    before = [n - first[i // fragments * fragments][1] for i, (_, n) in enumerate(first)]
    offset = F.get(F.array(*[F.lit(n).cast("long") for n in before]), F.col(own["fragment"]))
    order = Window.partitionBy(own["fragment"]).orderBy(*[own[n] for n in KEY])
    placed = stored.withColumn(own["fragment"], _assign(cuts, own)).repartition(max(shuffle_partitions(spark), 1), own["fragment"])
    out = placed.withColumn("slot", F.row_number().over(order).cast("long") - 1 + offset)
    out = out.withColumns({"shard": F.floor(F.col(own["fragment"]) / fragments).cast("int"), "size": F.col(own["size"])})
    return out.select(*[F.col(f"`{c}`") for c in named.columns], "size", "shard", "slot")


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write each shard's rows under ``shard=<n>`` in slot order within files."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
