"""Operator 2: encoding and decoding with merge-type piece vocabularies.

Encoding keeps an agenda of adjacent symbol pairs ordered by the score of the piece that a merge would
make, the leftmost first among equals. The best pair is merged, its new neighbours join the agenda, and
pairs that no longer exist are passed over. Symbols that are no piece at the end become byte pieces.

Chunks of usual length share one agenda, held in arrays: each round takes the best pair of every chunk, merges
it and scores the pairs that its neighbours now make. A longer chunk has an agenda of its own, a heap.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.chunks import ChunkTable, collect, piece_chunks, piece_model
from tidepanel.llm.common import column_list, slices

MARK = "▁"
BATCH_BYTES = 2 << 20
#: Characters of a chunk that joins the shared agenda, which takes a round for each merge of its longest chunk.
SHARED_CHARS = 48


class PieceCodec:
    """Vocabulary tables of one model file, with ``encode`` and ``decode`` of single texts."""

    def __init__(self, path: str):
        self.model, self.safe = piece_model(path)
        m = self.model
        size = m.get_piece_size()
        self.names = [m.id_to_piece(i) for i in range(size)]
        self.hidden = {i for i in range(size) if m.is_control(i)}
        self.unknown = m.unk_id()
        self.byte_of = {i: int(self.names[i][3:5], 16) for i in range(size) if m.is_byte(i)}
        self.id_of_byte = {b: i for i, b in self.byte_of.items()}
        special = self.hidden | self.byte_of.keys() | {self.unknown}
        self.ids = {p: i for i, p in enumerate(self.names) if i not in special}
        # smaller is better: the agenda is a min-heap
        self.rank = {p: -m.get_score(i) for p, i in self.ids.items()}
        self.end = m.eos_id()
        self._number_symbols()

    def _number_symbols(self) -> None:
        """Numbers for all that the shared agenda can hold: pieces and characters; other characters get theirs when they occur."""
        symbols = list(dict.fromkeys(chain(self.rank, *self.rank, MARK)))
        number = {s: n for n, s in enumerate(symbols)}
        self.symbols: list[str] = []
        self.parts: list[list[int]] = []
        self.spelled: list[bytes] = []
        self.said: list[bytes] = []
        self.symbol_of = np.full(sys.maxunicode + 1, -1, dtype=np.int64)
        self._add_symbols(symbols)
        pairs = {}
        for p in self.rank:
            for k in range(1, len(p)):
                a, b = number.get(p[:k]), number.get(p[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = number[p]
        self.pairs = pd.Index(np.fromiter(pairs.keys(), np.int64, len(pairs)))
        # the last entry is that of a pair which is no piece
        self.makes = np.array([*pairs.values(), len(symbols)], dtype=np.int64)
        _, order = np.unique([self.rank.get(s, np.inf) for s in symbols] + [np.inf], return_inverse=True)
        self.order = order.astype(np.int64) << 32

    def _add_symbols(self, symbols: Iterable[str]) -> None:
        for symbol in symbols:
            if len(symbol) == 1:
                self.symbol_of[ord(symbol)] = len(self.symbols)
            ids = self._ids_of(symbol)
            self.symbols.append(symbol)
            self.parts.append(ids)
            self.spelled.append("".join(f" {i}" for i in ids).encode())
            self.said.append(self.decode_raw(ids).encode())
        # by symbol: its ids, bytes of their decimals, bytes of their text
        self.widths = np.array([list(map(len, t)) for t in (self.parts, self.spelled, self.said)], dtype=np.int64)

    def _ids_of(self, symbol: str) -> list[int]:
        found = self.ids.get(symbol)
        if found is not None:
            return [found]
        return [self.id_of_byte[b] for b in symbol.encode()] if self.id_of_byte else [self.unknown]

    def merge_many(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``merge`` of many chunks, none empty: the numbers of their symbols, chunk after chunk, and how many each has."""
        codes = np.frombuffer((MARK + MARK.join(chunks)).replace(" ", MARK).encode("utf-32-le"), "<u4")
        symbols = self.symbol_of[codes]
        if (symbols < 0).any():
            self._add_symbols(map(chr, np.unique(codes[symbols < 0]).tolist()))
            symbols = self.symbol_of[codes]
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks)) + 1
        owners = np.arange(len(chunks))
        none = len(self.order) - 1
        made = np.full(len(symbols), none)
        made[:-1] = self._made(symbols[:-1], symbols[1:])
        made[sizes.cumsum() - 1] = none
        done, whose = [], []
        while len(owners):
            starts = sizes.cumsum() - sizes
            # the best score of a chunk, the leftmost pair among equals
            best = np.minimum.reduceat(self.order[made] | np.arange(len(made)), starts)
            open_ = best < self.order[none]
            if not open_.all():
                ended = np.repeat(~open_, sizes)
                done.append(symbols[ended])
                whose.append(np.repeat(owners[~open_], sizes[~open_]))
                kept_before = (~ended).cumsum()
                symbols, made, owners, sizes, best = symbols[~ended], made[~ended], owners[open_], sizes[open_], best[open_]
                at = kept_before[best & 0xFFFFFFFF] - 1
            else:
                at = best & 0xFFFFFFFF
            if not len(owners):
                break
            symbols[at] = made[at]
            rest = np.ones(len(symbols), dtype=bool)
            rest[at + 1] = False
            last = sizes.cumsum() - 1 == at + 1
            symbols, made = symbols[rest], made[rest]
            sizes = sizes - 1
            at = at - np.arange(len(at))
            made[at] = none
            right = at[~last]
            made[right] = self._made(symbols[right], symbols[right + 1])
            left = at[at > sizes.cumsum() - sizes]
            made[left - 1] = self._made(symbols[left - 1], symbols[left])
        whose = np.concatenate(whose)
        by_chunk = np.argsort(whose, kind="stable")
        return np.concatenate(done)[by_chunk], np.bincount(whose, minlength=len(chunks))

    def _made(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The symbols that pairs make, by number; the number behind all pieces where they make none."""
        return self.makes[self.pairs.get_indexer(left << 32 | right)]

    def merge(self, symbols: list[str]) -> list[str]:
        """Merge adjacent symbols by the agenda until no neighbouring pair is a piece."""
        rank, n = self.rank, len(symbols)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            pair = symbols[i] + symbols[i + 1]
            if pair in rank:
                agenda.append((rank[pair], i, pair))
        heapify(agenda)
        while agenda:
            _, i, pair = heappop(agenda)
            j = after[i]
            # a pair is out of date once either side has changed: then its text differs
            if not symbols[i] or j >= n or len(symbols[i]) + len(symbols[j]) != len(pair) or symbols[i] + symbols[j] != pair:
                continue
            symbols[i], symbols[j] = pair, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                joined = pair + symbols[k]
                if joined in rank:
                    heappush(agenda, (rank[joined], i, joined))
            h = before[i]
            if h >= 0:
                joined = symbols[h] + pair
                if joined in rank:
                    heappush(agenda, (rank[joined], h, joined))
        return [s for s in symbols if s]

    def encode(self, text: str) -> list[int]:
        """Ids of a text, without begin and end ids."""
        if not text:
            return []
        return [i for symbol in self.merge(list(MARK + text.replace(" ", MARK))) for i in self._ids_of(symbol)]

    def decode_raw(self, ids: list[int]) -> str:
        """Text of ids before the mark of the beginning is taken away."""
        out: list[str] = []
        run = bytearray()
        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(_from_bytes(run))
                run = bytearray()
            if i == self.unknown:
                out.append(" ⁇ ")
            elif i not in self.hidden:
                out.append(self.names[i].replace(MARK, " "))
        if run:
            out.append(_from_bytes(run))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        text = self.decode_raw(ids)
        return text[1:] if text[:1] == " " and next((self.names[i][:1] == MARK for i in ids if i not in self.hidden), False) else text

    def checked(self, chunks: list[str]) -> list[tuple[bytes, bytes]]:
        """(ids as b" 12 34", decoded bytes) by chunk, after a comparison with the library."""
        shared = [c for c in chunks if 0 < len(c) <= SHARED_CHARS]
        found = dict(zip(shared, self._checked_together(shared), strict=True)) if shared else {}
        return [found[c] if c in found else self._checked_alone(c) for c in chunks]

    def _checked_together(self, chunks: list[str]) -> list[tuple[bytes, bytes]]:
        symbols, sizes = self.merge_many(chunks)
        counts, lines, texts = (self.widths[k][symbols].cumsum()[sizes.cumsum() - 1] for k in range(3))
        names = symbols.tolist()
        ids = list(chain.from_iterable(map(self.parts.__getitem__, names)))
        theirs = self.model.encode(chunks, num_threads=1)
        same = ids == list(chain.from_iterable(theirs)) and np.array_equal(counts, np.fromiter(map(len, theirs), np.int64, len(theirs)).cumsum())
        text = b"".join(map(self.said.__getitem__, names))
        if not same or text.decode()[1:] != self.model.decode(ids):
            return [self._checked_alone(c, i) for c, i in zip(chunks, np.split(np.array(ids), counts[:-1]), strict=True)]
        line = b"".join(map(self.spelled.__getitem__, names))
        lines, texts = lines.tolist(), texts.tolist()
        return [(line[a:b], text[c:d]) for a, b, c, d in zip([0, *lines], lines, [0, *texts], texts, strict=False)]

    def _checked_alone(self, chunk: str, ids: Iterable[int] | None = None) -> tuple[bytes, bytes]:
        own = self.encode(chunk) if ids is None else list(map(int, ids))
        theirs = self.model.encode(chunk)
        if own != theirs:
            raise ValueError(f"encoding differs from the library's for {chunk[:80]!r}: {own[:40]} and {theirs[:40]}")
        raw = self.decode_raw(own)
        if raw[1:] != self.model.decode(own):
            raise ValueError(f"decoding differs from the library's for {chunk[:80]!r}")
        return "".join(f" {i}" for i in own).encode(), raw.encode()


def _from_bytes(run: bytearray) -> str:
    """Bytes as text; each byte that starts no character gives one replacement mark."""
    out, i = [], 0
    while i < len(run):
        for width in (1, 2, 3, 4):
            try:
                out.append(bytes(run[i : i + width]).decode())
                i += width
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


@lru_cache(maxsize=2)
def codec(path: str) -> tuple[PieceCodec, ChunkTable]:
    """The codec of a model file and this worker's table of chunks."""
    own = PieceCodec(path)
    return own, ChunkTable(own.checked, batch_bytes=512 << 10)


def _join(results) -> tuple[bytes, bytes]:
    ids, texts = zip(*results, strict=True) if (results := list(results)) else ((), ())
    return b"".join(ids), b"".join(texts)


def encode_texts(texts: list[str | None], path: str) -> list[tuple[bytes, bytes]]:
    """For each text: its ids as decimal numbers each after a space, and its decoded bytes with the leading mark."""
    own, table = codec(path)
    cut = piece_chunks if own.safe else (lambda text: [text] if text else [])
    return collect(texts, cut, table, _join, _join)


def encode_documents(docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text", payload: str = "ids") -> DataFrame:
    """Encode every whole text with an end id, decode the ids again.

    ``payload="ids"`` returns id, ``n_tokens``, ``ids`` (array of int) and ``decoded``;
    ``payload="digest"`` returns id, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``, made where the
    ids are, so that no ids travel.

    Every distinct chunk is encoded by the agenda and compared with the sentencepiece library in
    batches, both ways; a difference stops the job. Null and empty texts give the end id alone and
    decode to the empty text. Very long texts pass in windows cut at safe boundaries; nothing is
    truncated. Repeated rows and null ids are treated row by row; an empty table gives an empty
    result; other columns are not read.
    """
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = codec(model)[0].end
        tail = f" {end}".encode()
        for whole in batches:
            for batch in slices(whole, "text", BATCH_BYTES):
                counts, ids, texts = [], [], []
                for a, b in encode_texts(column_list(batch, "text"), model):
                    a += tail
                    counts.append(a.count(b" "))
                    b = b[1:] if b[:1] == b" " else b
                    if payload == "digest":
                        ids.append(hashlib.sha256(a[1:]).hexdigest())
                        texts.append(hashlib.sha256(b).hexdigest())
                    else:
                        ids.append(list(map(int, a.split())))
                        texts.append(b.decode())
                form = pa.string() if payload == "digest" else pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, form), pa.array(texts, pa.string())], names)

    names = [id_col, "n_tokens", *(("ids_sha256", "decoded_sha256") if payload == "digest" else ("ids", "decoded"))]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    second = "string" if payload == "digest" else "array<int>"
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, {names[2]} {second}, {names[3]} string")
