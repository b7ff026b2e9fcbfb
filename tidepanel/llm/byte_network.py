"""Operator 13: text quality by a convolutional network on bytes, in numpy.

* A text is its UTF-8 bytes. Byte ``i`` starts a window of ``WIDTH`` bytes; past the end stand zeros. Learned filters
  (a byte embedding times weights by place in the window) respond to every window of the text.
* Windows lie in *cells* of ``CELL`` starts, cells in chunks of ``CHUNK_CELLS``, each sharing one cell with the next. A filter's largest
  response in a chunk, less a learned threshold, is what the chunk says.
* Mean and maximum over all chunks of the text go through one hidden layer to one probability.

Texts of one letter case, of stray signs and tables move the mean of some filters; texts that repeat a few words leave most filters
silent in most chunks. Fitting is stochastic gradient descent (Adam) with gradients by hand: of each chunk and filter only
the window with the largest response gets one. The fit reads a bounded sample; scoring reads whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import fresh, set_aside, slices

WIDTH, CELL, CHUNK_CELLS = 8, 32, 8
STEP_CELLS = CHUNK_CELLS - 1
#: Cells of a text that are scored at once; a multiple of the step, and one.
PIECE_CELLS = STEP_CELLS * 4096 + 1
BATCH_BYTES = 1 << 20
#: Cells whose responses are held at once.
BLOCK = 2048


@dataclass(frozen=True)
class NetworkPlan:
    """Sizes of the network and bounds of the fit.

    ``rows``: labelled texts that a fit reads at most, half of each label. ``chunks``: chunks of each that it keeps at most, spread
    evenly over the whole text. ``each``: chunks of each that one epoch looks at, drawn anew.
    """

    filters: int = 32
    embed: int = 8
    hidden: int = 16
    rows: int = 2_000
    chunks: int = 48
    each: int = 8
    epochs: int = 14
    batch: int = 32
    rate: float = 0.01
    decay: float = 1e-4
    seed: int = 7


@dataclass
class ByteNetwork:
    """Parameters; ``offset`` is added to the last sum so that the score follows the labels' own shares."""

    embed: np.ndarray  # (256, D); zero for the byte 0
    filters: np.ndarray  # (WIDTH, D, F)
    thresholds: np.ndarray  # (F)
    hidden: np.ndarray  # (2 F, G)
    hidden_bias: np.ndarray
    out: np.ndarray  # (G)
    out_bias: np.ndarray  # (1)
    offset: float = 0.0

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.thresholds, self.hidden, self.hidden_bias, self.out, self.out_bias]

    def combine(self, mean: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Probabilities from mean and maximum over chunks, in double precision."""
        z = np.concatenate([mean, most], axis=1).astype(np.float64)
        logit = np.tanh(z @ self.hidden + self.hidden_bias) @ self.out + self.out_bias[0] + self.offset
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def cells_of(n_bytes: int) -> int:
    """Cells of a text: the last one holds a window of zeros alone."""
    return n_bytes // CELL + 1


def chunk_starts(cells: int) -> np.ndarray:
    """First cells of the chunks that cover ``cells`` cells."""
    return np.arange(0, max(cells - 1, 1), STEP_CELLS)


class Scorer:
    """A network with its filters as tables by pairs of bytes, built once by a worker."""

    def __init__(self, net: ByteNetwork):
        self.net = net
        by_place = np.einsum("bd,kdf->kbf", net.embed, net.filters).astype(np.float32)
        self.tables = [(by_place[k][:, None] + by_place[k + 1][None]).reshape(65536, -1) for k in range(0, WIDTH, 2)]

    def cell_maxima(self, data: np.ndarray) -> np.ndarray:
        """Largest response of each filter in each cell of ``data`` (whole cells, zeros behind)."""
        cells = len(data) // CELL
        padded = np.concatenate([data, np.zeros(WIDTH, np.uint8)]).astype(np.intp)
        pairs = padded[:-1] * 256 + padded[1:]
        out = np.empty((cells, self.net.thresholds.size), np.float32)
        one, two = (np.empty((min(BLOCK, cells), out.shape[1]), np.float32) for _ in range(2))
        for first in range(0, cells, BLOCK):
            best = out[first : first + BLOCK]
            n = len(best)
            total, part = one[:n], two[:n]
            for j in range(CELL):
                for m, table in enumerate(self.tables):
                    at = first * CELL + j + 2 * m
                    places = pairs[at : at + n * CELL : CELL]
                    np.take(table, places, axis=0, out=part if m else total, mode="clip")
                    if m:
                        total += part
                if j:
                    np.maximum(best, total, out=best)
                else:
                    best[:] = total
        return out

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        """Probabilities of whole texts, given as byte arrays."""
        f = self.net.thresholds.size
        sums, most, chunks = np.zeros((len(texts), f)), np.full((len(texts), f), -np.inf), np.zeros(len(texts))
        held, size = [], 0

        def flush() -> None:
            nonlocal held, size
            if not held:
                return
            # each piece is followed by one more cell: what its last windows read, or zeros
            data = np.zeros(sum(c + 1 for _, _, c in held) * CELL, np.uint8)
            marks, owners, at = [], [], 0
            for doc, first, cells in held:
                part = texts[doc][first * CELL : (first + cells + 1) * CELL]
                data[at * CELL : at * CELL + len(part)] = part
                starts = chunk_starts(cells)
                marks.append(np.stack([at + starts, at + np.minimum(starts + CHUNK_CELLS, cells)], axis=1).ravel())
                owners.append(np.full(len(starts), doc))
                at += cells + 1
            said = np.maximum.reduceat(self.cell_maxima(data), np.concatenate(marks), axis=0)[::2]
            said = np.maximum(said + self.net.thresholds.astype(np.float32), 0)
            owner = np.concatenate(owners)
            heads = np.flatnonzero(np.diff(owner, prepend=-1))
            own = owner[heads]
            sums[own] += np.add.reduceat(said.astype(np.float64), heads, axis=0)
            most[own] = np.maximum(most[own], np.maximum.reduceat(said, heads, axis=0))
            chunks[own] += np.diff(np.append(heads, len(owner)))
            held, size = [], 0

        for doc, text in enumerate(texts):
            cells = cells_of(len(text))
            # pieces share one cell, as chunks do
            for first in range(0, max(cells - 1, 1), PIECE_CELLS - 1):
                held.append((doc, first, min(cells - first, PIECE_CELLS)))
                size += held[-1][2]
                if size * CELL >= BATCH_BYTES:
                    flush()
        flush()
        return self.net.combine(sums / np.maximum(chunks, 1)[:, None], most) if texts else np.empty(0)


def bytes_of(batch: pa.RecordBatch, place: int) -> list[np.ndarray]:
    """The UTF-8 bytes of each text of a batch (null: none), without copies."""
    column = batch.column(place)
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    _, offsets, data = column.buffers()
    if not len(column):
        return []
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def text_chunks(text: np.ndarray, most: int) -> np.ndarray:
    """At most ``most`` chunks of a text, spread evenly, each with the bytes that its last windows read."""
    starts = chunk_starts(cells_of(len(text)))
    if len(starts) > most:
        starts = starts[np.linspace(0, len(starts) - 1, most).round().astype(int)]
    length = CHUNK_CELLS * CELL + WIDTH - 1
    out = np.zeros((len(starts), length), np.uint8)
    for row, s in zip(out, starts, strict=True):
        part = text[s * CELL : s * CELL + length]
        row[: len(part)] = part
    return out


def gradients(net: ByteNetwork, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean loss and its gradients; ``x`` (texts, chunks, bytes) holds as many chunks of each text."""
    n, each, length = x.shape
    d, f = net.embed.shape[1], net.thresholds.size
    flat = x.reshape(n * each, length)
    emb = net.embed[flat].astype(np.float32)
    starts = length - WIDTH + 1
    windows = np.lib.stride_tricks.as_strided(emb, (n * each, starts, WIDTH * d), (emb.strides[0], emb.strides[1], emb.strides[2]))
    weights = net.filters.reshape(WIDTH * d, f)
    answer = (windows.reshape(-1, WIDTH * d) @ weights.astype(np.float32)).reshape(n * each, starts, f)
    at = answer.argmax(axis=1)
    top = np.take_along_axis(answer, at[:, None], axis=1)[:, 0] + net.thresholds
    said = np.maximum(top, 0).reshape(n, each, f)
    best = said.argmax(axis=1)
    z = np.concatenate([said.mean(axis=1), np.take_along_axis(said, best[:, None], axis=1)[:, 0]], axis=1)
    h = np.tanh(z @ net.hidden + net.hidden_bias)
    logit = h @ net.out + net.out_bias[0]
    p = 1 / (1 + np.exp(-np.clip(logit, -40, 40)))
    loss = float(np.mean(np.logaddexp(0, logit) - y * logit))
    g = (p - y) / n
    g_h = np.outer(g, net.out) * (1 - h * h)
    g_z = g_h @ net.hidden.T
    g_said = np.repeat(g_z[:, None, :f] / each, each, axis=1)
    np.put_along_axis(g_said, best[:, None], np.take_along_axis(g_said, best[:, None], axis=1) + g_z[:, None, f:], axis=1)
    g_top = g_said.reshape(n * each, f) * (top > 0)
    row = np.arange(n * each)[:, None]
    seen = windows[row, at]  # (chunks, F, WIDTH D): the windows that were largest
    g_filters = np.einsum("nf,nfk->kf", g_top, seen)
    back = (g_top[:, :, None] * weights.T[None]).reshape(-1, d)
    places = flat[row[:, :, None], at[:, :, None] + np.arange(WIDTH)].ravel()
    g_embed = np.stack([np.bincount(places, weights=back[:, i], minlength=256) for i in range(d)], axis=1)
    g_embed[0] = 0
    return loss, [g_embed, g_filters.reshape(net.filters.shape), g_top.sum(axis=0), z.T @ g_h, g_h.sum(axis=0), h.T @ g, np.array([g.sum()])]


def fresh_network(plan: NetworkPlan) -> ByteNetwork:
    rng = np.random.default_rng(plan.seed)
    embed = rng.normal(0, 0.5, (256, plan.embed))
    embed[0] = 0
    return ByteNetwork(
        embed,
        rng.normal(0, 1 / np.sqrt(WIDTH * plan.embed), (WIDTH, plan.embed, plan.filters)),
        np.zeros(plan.filters),
        rng.normal(0, 1 / np.sqrt(2 * plan.filters), (2 * plan.filters, plan.hidden)),
        np.zeros(plan.hidden),
        rng.normal(0, 1 / np.sqrt(plan.hidden), plan.hidden),
        np.zeros(1),
    )


def train(texts: list[np.ndarray], labels: np.ndarray, plan: NetworkPlan) -> ByteNetwork:
    """A network for texts given as chunks; batches hold as many texts of either label."""
    net, rng = fresh_network(plan), np.random.default_rng(plan.seed + 1)
    params = net.parameters()
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    sides = [np.flatnonzero(labels == side) for side in (0, 1)]
    half = plan.batch // 2
    steps = max(4, -(-max(map(len, sides)) // half))
    done, total = 0, steps * plan.epochs
    for _ in range(plan.epochs):
        orders = [np.concatenate([rng.permutation(s) for _ in range(-(-steps * half // len(s)))]) for s in sides]
        for step in range(steps):
            own = np.concatenate([o[step * half : (step + 1) * half] for o in orders])
            x = np.stack([texts[i][np.resize(rng.permutation(len(texts[i])), plan.each)] for i in own])
            _, grads = gradients(net, x, labels[own].astype(float))
            done += 1
            rate = plan.rate * 0.5 * (1 + np.cos(np.pi * done / total))
            for p, g, a, b in zip(params, grads, first, second, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= rate * (a / (1 - 0.9**done) / (np.sqrt(b / (1 - 0.999**done)) + 1e-8) + plan.decay * p)
    return net


def fold_of(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % folds


def fit_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 4, held: int = 2, plan: NetworkPlan = NetworkPlan()) -> ByteNetwork | None:
    """Fit on at most about ``plan.rows`` labelled texts whose id is not in the held-out fold; a hash of the id decides which.

    An id that is labelled both ways says nothing; one that repeats a label counts once; null ids and labels are left
    out. Rows that share an id are all read. Without texts of both labels nothing is learned (None).
    """
    train_rows = labels.where(F.col(f"`{id_col}`").isNotNull() & F.col(f"`{label_col}`").isin(0, 1) & (fold_of(id_col, folds) != held))
    label = F.col(f"`{label_col}`")
    agreed = train_rows.groupBy(F.col(f"`{id_col}`").alias("id")).agg(F.min(label).cast("int").alias("label"), F.max(label).cast("int").alias("other")).where("label = other")
    sizes = {r["label"]: r["n"] for r in agreed.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return None
    shares = [min(1.0, plan.rows / 2 / sizes[side]) for side in (0, 1)]
    drawn = F.pmod(F.xxhash64("id", F.lit("network")), F.lit(1_000_000)) < F.when(F.col("label") == 0, int(1e6 * shares[0])).otherwise(int(1e6 * shares[1]))
    # bounded by ``plan.rows``, so it may be broadcast
    ids = agreed.where(drawn).select("id", "label")
    most = plan.chunks

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunks = [text_chunks(t, most).tobytes() for t in bytes_of(batch, 0)]
            yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.binary()), batch.column(1)], ["chunks", "label"])

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(ids), "id")
    got = rows.select("text", "label").mapInArrow(cut, "chunks binary, label int").toArrow()
    length = CHUNK_CELLS * CELL + WIDTH - 1
    found = sorted(zip(got.column("label").to_pylist(), got.column("chunks").to_pylist(), strict=True))
    y = np.array([label for label, _ in found])
    if not 0 < y.sum() < len(y):
        return None
    net = train([np.frombuffer(c, np.uint8).reshape(-1, length) for _, c in found], y, plan)
    net.offset = float(np.log(sizes[1] / sizes[0]))
    return net


def score_quality(docs: DataFrame, net: ByteNetwork | None, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = 0.7) -> DataFrame:
    """The columns ``keep`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on) of every whole text.

    Null and empty texts score as a chunk of zeros. Repeated rows score alike; an empty table gives an empty result. Very
    long texts pass in pieces that share a cell, and none of their bytes is left out. Without a network every score is 0.5. Kept
    columns that are called like an added one are renamed to ``input_<name>``; others are not read.
    """
    named = set_aside(docs.select(*[F.col(f"`{c}`") for c in keep]), ("score", "predicted"))
    text, names = fresh(named, "_text"), named.columns
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)], F.col(f"`{text_col}`").alias(text))
    fields = ", ".join(f"`{n}` {t}" for n, t in named.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(net) if net is not None else None
        for whole in batches:
            for batch in slices(whole, text, BATCH_BYTES):
                scores = own.scores(bytes_of(batch, len(names))) if own else np.full(batch.num_rows, 0.5)
                arrays = [batch.column(i) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32))], [*names, "score", "predicted"])

    return rows.mapInArrow(run, f"{fields}, score double, predicted int")
