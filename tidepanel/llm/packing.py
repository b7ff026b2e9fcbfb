"""Operator 4: best-fit packing of documents into sequences, certified by lower bounds.

Documents are tokenised, cut where they are longer than a sequence, and the pieces are packed. Packing
works on partitions of bounded size. In each, best-fit decreasing packs the pieces and dual-feasible
functions bound the number of bins from below. A partition whose bins equal its bound is certified and
closed. The others have a gap: they open their emptiest bins and exchange the pieces, eight partitions
sending theirs to one, where best-fit decreasing runs again. It ends when every partition is certified,
when the bins in use equal the bound over all pieces, or when one partition is left.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.chunks import TABLE_BYTES, ChunkTable, collect, word_chunks
from tidepanel.llm.common import discard, fresh, materialize, parts_for, set_aside, slices
from tidepanel.llm.token_counts import drops_white_space
from tidepanel.llm.units import UnitTable

BATCH_BYTES = 2 << 20
#: Pieces of a partition. A certified partition wastes less than one bin, so the fewer the better.
PARTITION_PIECES = 65_536
#: Partitions whose open bins meet in one in the next round.
FAN_IN = 8

#: A lower-case word of Latin letters.
_PLAIN = re.compile("[a-zà-öø-ÿ]+").fullmatch
#: Words that go to the library as one text.
WORDS_AT_ONCE = 250
_TABLES: dict[str, tuple] = {}


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins of bytes in byte-level vocabularies: bytes that print stand for themselves."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    table, more = {}, 256
    for byte in range(256):
        if byte in shown:
            table[byte] = chr(byte)
        else:
            table[byte] = chr(more)
            more += 1
    return table


class IdCodec:
    """Ids of chunks as little-endian unsigned 32-bit numbers, by the tokenizers library."""

    def __init__(self, path: str):
        # a task has one core: the library's threads would only wait for work
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.drops = drops_white_space(self.tokenizer.to_str())
        self.letters = _byte_letters()
        # the merges alone, for words whose bytes are letters already
        model = self.tokenizer.model
        self.merges = Tokenizer(model)
        self.merges.pre_tokenizer = WhitespaceSplit()
        suffix = getattr(model, "end_of_word_suffix", None) or ""
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.closes = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
        self.closes[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        # plain words may go to the merges at once only where that gives what the whole tokenizer gives
        probes = ["Straße", "señor", "êtreÀ", "dog", "THE", "ÿ", "ŵ".encode().decode("latin-1")[:1] + "x"]
        self.simple = self.drops and bool(suffix)
        self.simple = self.simple and self._words([p.lower() for p in probes]) == [self._pack(self._whole(p)) for p in probes]
        self.simple = self.simple and all(self._pack(self._whole(p)) + self._pack(self._whole("...")) == self._pack(self._whole(p + "...")) for p in probes)

    @staticmethod
    def _pack(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _words(self, words: list[str]) -> list[bytes] | None:
        """Ids of lower-case words of letters, many to a call; the end of a word is told by its last token. None if the ends do not fit."""
        spelt = [w if w.isascii() else w.encode().decode("latin-1").translate(self.letters) for w in words]
        texts = [" ".join(spelt[i : i + WORDS_AT_ONCE]) for i in range(0, len(spelt), WORDS_AT_ONCE)]
        ids: list[int] = []
        for found in self.merges.encode_batch_fast(texts, add_special_tokens=False):
            ids += found.ids
        packed = np.array(ids, dtype="<u4")
        data = packed.tobytes()
        ends = (4 * (np.flatnonzero(self.closes[packed]) + 1)).tolist()
        if len(ends) != len(words) or (ends and ends[-1] != len(data)):
            return None
        return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def encode(self, chunks: list[str]) -> list[bytes]:
        plain = [c for c in chunks if _PLAIN(c)] if self.simple else []
        words = self._words(plain)
        found = {} if words is None else dict(zip(plain, words, strict=True))
        whole = [c for c in chunks if c not in found]
        others = map(self._pack, [e.ids for e in self.tokenizer.encode_batch_fast(whole, add_special_tokens=False)])
        return [found[c] if c in found else next(others) for c in chunks]


def ids_of_column(texts: pa.Array, path: str, table_bytes: int = TABLE_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """The ids of whole texts, one text behind the other, and where each begins and the last one ends; ``table_bytes`` of keys are remembered."""
    if path not in _TABLES:
        own = IdCodec(path)
        _TABLES[path] = (own, UnitTable(own.encode, table_bytes) if own.simple else ChunkTable(own.encode))
    own, table = _TABLES[path]
    table.table_bytes = table_bytes
    if own.simple:
        return table.texts(texts)
    packed = collect(texts.to_pylist(), word_chunks if own.drops else (lambda text: [text]), table, b"".join, b"".join)
    return np.frombuffer(b"".join(packed), "<u4"), np.cumsum([0, *map(len, packed)]) // 4


def ids_of_texts(texts: list[str | None], path: str, table_bytes: int = TABLE_BYTES) -> list[bytes]:
    """The ids of whole texts, each as packed little-endian 32-bit numbers; ``table_bytes`` of keys are remembered."""
    ids, places = ids_of_column(pa.array(texts, pa.string()), path, table_bytes)
    return [ids[a:b].tobytes() for a, b in zip(places, places[1:], strict=False)]


def cut_pieces(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, payload: str = "ids", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """Tokenise whole texts, add ``end_id`` and cut what is longer than ``capacity``.

    Returns id, ``piece``, ``start``, ``length`` and ``ids`` (array of int), or with
    ``payload="crc32"`` ``ids_crc32`` in place of the ids, so that no ids travel. A null or empty text
    is one piece that holds the end id alone. ``table_bytes``: keys of chunks that a worker remembers between batches;
    fewer take less memory and more time, and give the same ids.
    """
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", BATCH_BYTES):
                ids, places = ids_of_column(batch.column(1), tokenizer, table_bytes)
                ids = np.insert(ids, places[1:], end_id)
                places = places + np.arange(len(places))  # an end id for each text before
                counts = -(-np.diff(places) // capacity)
                rows = np.repeat(np.arange(len(counts)), counts)
                pieces = np.arange(len(rows)) - np.repeat(counts.cumsum() - counts, counts)
                starts = pieces * capacity
                at = np.append(places[rows] + starts, len(ids))  # pieces lie one behind the other
                if payload == "crc32":
                    data = memoryview(ids).cast("B")
                    load = pa.array([zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(at.tolist(), at[1:].tolist(), strict=False)], pa.int64())
                else:
                    load = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.view("<i4")))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(pieces, pa.int32()), pa.array(starts), pa.array(np.diff(at)), load], names)

    names = [id_col, "piece", "start", "length", "ids_crc32" if payload == "crc32" else "ids"]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, {names[4]} {'long' if payload == 'crc32' else 'array<int>'}")


def dff_bound_of_counts(occurs: dict[int, int], capacity: int) -> int:
    """A lower bound of the bins that pieces need, from {length: pieces}, by dual-feasible functions.

    A dual-feasible function maps sizes so that no full bin maps to more than one; the sum of the
    mapped sizes is then a bound. Three families: the identity, the threshold functions (sizes over
    capacity - t count whole, sizes under t not at all) and the rounding functions (size times k + 1
    over capacity, rounded down, in units of k, unless it is whole).
    """
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for size, n in occurs.items():
        counts[size] = n
    sizes = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((counts * sizes).sum()) // capacity)
    above = counts[::-1].cumsum()[::-1]  # pieces of at least this size
    weight = (counts * sizes).cumsum()
    for t in range(1, capacity // 2 + 1):
        middle = int(weight[capacity - t] - weight[t - 1])
        large = int(above[capacity - t + 1])
        best = max(best, large - (-middle // capacity))
    for k in range(1, 65):
        scaled = sizes * (k + 1)
        exact = scaled % capacity == 0
        units = np.where(exact, sizes * k, scaled // capacity * capacity)
        best = max(best, -(-int((counts * units).sum()) // (k * capacity)))
    return best


def dff_bound(lengths: np.ndarray, capacity: int) -> int:
    """The lower bound for a list of lengths."""
    return dff_bound_of_counts(dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True)), capacity)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins by best-fit decreasing: for each piece its bin and its offset; for each bin its room.

    Bins are kept by the room they have; a number whose bits tell which rooms occur finds the tightest
    bin at once.
    """
    bins = np.empty(len(lengths), dtype=np.int64)
    offsets = np.empty(len(lengths), dtype=np.int64)
    by_room: dict[int, list[int]] = {}
    rooms: list[int] = []
    occurs = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = occurs >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            stack = by_room[room]
            b = stack.pop()
            if not stack:
                occurs &= ~(1 << room)
        else:
            b, room = len(rooms), capacity
            rooms.append(capacity)
        bins[i], offsets[i] = b, capacity - room
        left = rooms[b] = room - size
        if left:
            stack = by_room.setdefault(left, [])
            if not stack:
                occurs |= 1 << left
            stack.append(b)
    return bins, offsets, np.array(rooms, dtype=np.int64)


def _pack_group(capacity: int, last: bool, budget: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "row"], ascending=[False, True], kind="stable").reset_index(drop=True)
        lengths = group["length"].to_numpy(np.int64)
        bins, offsets, rooms = best_fit_decreasing(lengths, capacity)
        bound = dff_bound(lengths, capacity)
        closed = np.full(len(rooms), True)
        if len(rooms) > bound and not last:
            # not certified: the emptiest bins are opened, as many as keep the partition that gets them in its size
            emptiest = np.argsort(-rooms, kind="stable")
            held = np.bincount(bins, minlength=len(rooms))[emptiest].cumsum()
            closed[emptiest[held <= budget]] = False
            closed |= rooms == 0
        return pd.DataFrame({"row": group["row"], "length": lengths, "part": int(group["part"].iloc[0]), "bin": bins, "offset": offsets, "closed": closed[bins], "bins": len(rooms), "bound": bound})

    return run


def _bound_of(pieces: DataFrame, capacity: int) -> int:
    """The lower bound over all pieces; reads one row for each length that occurs."""
    rows = pieces.where(F.col("length").between(1, capacity)).groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()
    return dff_bound_of_counts({r["length"]: r["n"] for r in rows}, capacity)


def pack(pieces: DataFrame, *, capacity: int = 2048, length_col: str = "length", partition_pieces: int = PARTITION_PIECES) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces, in as few sequences as best-fit finds.

    Pieces of full length are sequences of their own. The others get a row number, are dealt evenly to
    partitions of about ``partition_pieces`` rows (so a hot document or length makes no hot partition),
    and are packed in rounds; between rounds only the pieces of the emptiest bins of partitions that
    are not certified travel, at most an eighth of ``partition_pieces`` from each of eight partitions to one,
    so that no partition outgrows its size. Also added: ``partition_bins`` and ``partition_bound``, the bins and
    the lower bound of the partition and round in which a piece found its place (equal: certified).
    The sequences exceed the bound over all pieces by less than one for each certified partition.

    A length that is null, below 1 or above ``capacity`` has no place: its row keeps null in the columns
    added. Input columns that are called like an added one are renamed to ``input_<name>``. Repeated
    rows are pieces of their own. An empty table gives an empty result. The pieces are written once to the
    shared folder and so is each round.
    """
    pieces = set_aside(pieces, ("sequence_id", "offset", "partition_bins", "partition_bound"))
    if length_col not in pieces.columns:
        length_col = f"input_{length_col}"
    row = fresh(pieces, "row_number")
    numbered = materialize(pieces.withColumn(row, F.monotonically_increasing_id()), "pieces")
    skinny = numbered.select(F.col(row).alias("row"), F.col(length_col).cast("long").alias("length"))
    one = F.lit(1).cast("long")
    whole = skinny.where(F.col("length") == capacity).select("row", F.col("row").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), one.alias("partition_bins"), one.alias("partition_bound"))
    open_rows = skinny.where((F.col("length") >= 1) & (F.col("length") < capacity))
    goal = _bound_of(open_rows, capacity)
    parts = parts_for(open_rows.count(), partition_pieces)
    placed, used = [whole], 0
    left = open_rows.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)))
    schema = "row long, length long, part long, bin long, offset long, closed boolean, bins long, bound long"
    round_no = 0
    while goal:
        round_no += 1
        done = materialize(left.groupBy("part").applyInPandas(_pack_group(capacity, parts == 1, partition_pieces // FAN_IN), schema), f"packed-{round_no}")
        # bins of this round, and those of them that stay
        held = done.groupBy("part", "bin").agg(F.first("closed").alias("closed"))
        bins, kept = held.agg(F.count(F.lit(1)), F.count(F.when(F.col("closed"), 1))).first()
        finished = kept == bins or used + bins <= goal
        # rows below 2^62 keep their own numbers; rounds, partitions and bins share those above
        number = F.lit(1 << 62) + F.lit(round_no << 56) + F.col("part") * F.lit(1 << 20) + F.col("bin")
        settled = done if finished else done.where("closed")
        placed.append(settled.select("row", number.alias("sequence_id"), "offset", F.col("bins").alias("partition_bins"), F.col("bound").alias("partition_bound")))
        if finished:
            break
        used += kept
        opened = done.where(~F.col("closed"))
        parts = parts_for(parts, FAN_IN)
        left = opened.select("row", "length", F.pmod(F.floor(F.col("part") / FAN_IN), F.lit(parts)).alias("part"))
    result = placed[0]
    for more in placed[1:]:
        result = result.unionByName(more)
    return numbered.join(result.withColumnRenamed("row", row), row, "left").select(*[F.col(f"`{c}`") for c in pieces.columns], "sequence_id", "offset", "partition_bins", "partition_bound")


def pack_documents(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, payload: str = "ids", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """Tokenise, cut and pack all documents: ``cut_pieces`` and then ``pack``."""
    return pack(cut_pieces(docs, tokenizer, id_col=id_col, text_col=text_col, capacity=capacity, end_id=end_id, payload=payload, table_bytes=table_bytes), capacity=capacity)


def corpus_bound(packed: DataFrame, *, capacity: int = 2048) -> tuple[int, int]:
    """(sequences used, lower bound over all pieces); reads one row for each length that occurs."""
    return packed.where("sequence_id is not null").select("sequence_id").distinct().count(), _bound_of(packed, capacity)
