"""Encoding of long texts as chunks that the tokenizer treats independently.

A *safe boundary* is a place where no token can cross and where the text may be cut without changing
the tokens on either side. Between safe boundaries a text falls into short chunks (words, mostly) that
recur all over a corpus, so each worker encodes a chunk once and keeps its result in a bounded table.
Whole texts are covered: a chunk is never shortened and a text is never truncated.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import lru_cache

#: Bytes of keys after which a worker's table of chunks is emptied, unless a caller says otherwise. With keys, values and slots
#: a table of short words takes some 20 times as much or more.
TABLE_BYTES = 8 << 20
#: Characters of text whose chunks are held as Python strings at once.
WINDOW = 1 << 20

_CUT = re.compile(r"(?<=[^ ▁]) (?!\Z)")


def piece_chunks(text: str) -> list[str]:
    """Cut for vocabularies whose pieces have the space mark only in front of other characters.

    A cut removes one space that follows another character; the mark that the tokenizer puts before
    every input stands in for it. A space that ends the text stays, as nothing would follow it, and so
    does one behind a space mark written in the text.
    """
    if "  " in text or text[:1] == " " or text[-1:] == " " or "▁" in text:
        return _CUT.split(text)
    return text.split(" ") if text else []


def word_chunks(text: str) -> list[str]:
    """Cut at white space for tokenizers that drop white space before they look for words."""
    return text.replace("\n", " ").replace("\t", " ").split(" ")


def windows(text: str, cut: Callable[[str], list[str]]) -> Iterable[list[str]]:
    """The chunks of a text in lists of bounded size, however long the text is."""
    if len(text) <= WINDOW:
        yield cut(text)
        return
    start = 0
    while len(text) - start > WINDOW:
        end = text.rfind(" ", start + 1, start + WINDOW)
        while end > start and text[end - 1] in " ▁":  # the first space of a run is the boundary
            end -= 1
        if end <= start:  # no boundary in this window: the next one behind it
            found = _CUT.search(text, start + 1)
            end = found.start() if found else len(text)
        yield cut(text[start:end])
        start = end + 1
    if start < len(text):
        yield cut(text[start:])


class ChunkTable:
    """Results by chunk. ``fill`` computes the missing ones in batches of bounded bytes."""

    def __init__(self, encode: Callable[[list[str]], list], batch_bytes: int = 256 << 10, table_bytes: int = TABLE_BYTES):
        self.encode, self.batch_bytes, self.table_bytes = encode, batch_bytes, table_bytes
        self.known: dict[str, object] = {}
        self.held = 0

    def fill(self, chunks: set[str]) -> dict[str, object]:
        missing = list(chunks.difference(self.known))
        size = sum(map(len, missing))
        if self.held + size > self.table_bytes and self.known:
            self.known.clear()
            self.held = 0
            missing = list(chunks)
            size = sum(map(len, missing))
        start, held = 0, 0
        for i, chunk in enumerate(missing):
            held += 4 * len(chunk)
            if held >= self.batch_bytes or i + 1 == len(missing):
                part = missing[start : i + 1]
                self.known.update(zip(part, self.encode(part), strict=True))
                start, held = i + 1, 0
        self.held += size
        return self.known


def collect(texts: list[str | None], cut: Callable[[str], list[str]], table: ChunkTable, join: Callable[[Iterable], object], merge: Callable[[list], object]) -> list:
    """For each text, ``join`` of the results of its chunks; ``merge`` puts windows of a long text together."""
    out, short, cuts = [], [], []
    for i, text in enumerate(texts):
        out.append(None)
        if text is not None and len(text) > WINDOW:
            parts = []
            for chunks in windows(text, cut):
                parts.append(join(map(table.fill(set(chunks)).__getitem__, chunks)))
            out[i] = merge(parts)
        else:
            short.append(i)
            cuts.append(cut(text or ""))
    need: set[str] = set()
    for chunks in cuts:
        need.update(chunks)
    get = table.fill(need).__getitem__
    for i, chunks in zip(short, cuts, strict=True):
        out[i] = join(map(get, chunks))
    return out


@lru_cache(maxsize=4)
def piece_model(path: str):
    """The sentencepiece processor of a model file, and whether its texts may be cut at spaces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    mark = "▁"
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    plain = [p for i, p in enumerate(names) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    inner = any(mark in p.lstrip(mark) for p in plain)
    # the mark is put before each input, runs of spaces survive, and characters are kept as they are
    exact = model.encode("a  b") == model.encode("a") + model.encode(" b") and model.decode(model.encode("Ａ  é")) == "Ａ  é"
    return model, mark in names and not inner and exact
