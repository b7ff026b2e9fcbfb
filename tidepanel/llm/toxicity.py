"""Operator 3: toxicity by weak supervision.

1. Voters. Each votes *toxic* or *civil* on a text or abstains. Lexicon voters are words, and pattern voters word beginnings, whose
   share of toxic texts among the labelled texts of the training folds is far from the average: high for toxic voters, low
   for civil ones, where there are any. Fixed pattern voters vote on masked spellings of lexicon words and on their share of the
   text (toxic), on polite words and on texts without any lexicon word (civil).
2. Label model. A generative model explains the votes on texts, labelled or not, by a hidden label; no given label takes
   part. Its parameters are each voter's rate of voting for either label (which gives its accuracy) and, along a forest that links
   the voters that depend most on each other given the label (by conditional mutual information), that rate where the other
   voter votes too (their correlation). Abstaining says nothing, and a vote says nothing against its own side. Expectation
   maximisation estimates all of them, from a start by the majority of votes; the forest is drawn from the posteriors and the
   model is fitted again.
3. Classifier. A logistic regression on hashed words and word beginnings is trained on the posterior labels.
   Its penalty sets the weights of most terms to zero, so that long texts do not gather noise; cells that
   the penalty would hold at zero from the start are left out.

Only texts feed a score. Labels of the training folds choose the voters and their sides and give the share of toxic texts, no more.
"""

from __future__ import annotations

import math
import re
import warnings
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import column_list, fresh, materialize, set_aside, slices

#: Labelled rows that a fit reads at most; which ones is decided by a hash of the id.
FIT_ROWS = 10_000
#: Texts, labelled or not, on whose votes the label model is fitted and on whose posteriors the classifier is trained, at most about.
VOTE_ROWS = 20_000
BATCH_BYTES = 2 << 20
#: Lengths of word beginnings that may become pattern voters.
STEMS = (3, 4, 5, 6, 7, 8)
#: Lexicon and pattern voters that a model has at most of each side: those that stand in most texts.
VOTERS = 256
#: Cells of hashed terms, lengths of hashed beginnings, and penalty of the classifier for each training text.
CELLS, BEGINNINGS, PENALTY = 1 << 20, (4, 5, 6, 7, 8), 4e-4
#: Votes that are added to each voter's, and the share of them that are right: what a toxic voter was chosen for. Civil voters
#: get half the average share of toxic texts. They keep the labels from fading into one, which the votes alone would not resist.
SMOOTH, TRUST = 2.0, 0.9
#: Signs that stand for letters in masked spellings (fixed values).
MASKS = ("013457@$", "oieastas")
#: Words of courtesy in English, German, French and Spanish.
POLITE = frozenset("please thanks thank sorry bitte danke verzeihung merci pardon gracias perdón".split())
FIXED = (("masked", 1), ("dense", 1), ("polite", -1), ("none", -1))
_WORD = re.compile(r"[^\W\d_]+")
_MASKED = re.compile(r"[^\W\d_]+(?:[013457@$]+[^\W\d_]+)+")
_UNMASK = str.maketrans(*MASKS)


def unmasked(text: str | None) -> set[str]:
    """Words of a text with signs for letters inside, spelled with the letters."""
    if not text or not any(c in text for c in MASKS[0]):
        return set()
    return {w.translate(_UNMASK) for w in _MASKED.findall(text.lower())}


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def terms_of(text: str | None) -> set[str]:
    """Distinct words (as they are) and word beginnings (with a star) of a text."""
    out = set(words_of(text))
    for n in STEMS:
        out |= {w[:n] + "*" for w in out if len(w) > n and w[-1] != "*"}
    return out


@dataclass
class Voters:
    """Lexicon and pattern voters of both sides, and the fixed ones; its size is bounded by ``VOTERS``."""

    toxic: list[str] = field(default_factory=list)
    civil: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        terms = [*self.toxic, *self.civil]
        self.names = [*terms, *(f"({name})" for name, _ in FIXED)]
        self.sides = np.array([1] * len(self.toxic) + [-1] * len(self.civil) + [side for _, side in FIXED])
        self.place = {t: i for i, t in enumerate(terms)}
        self.exact = {t for t in terms if t[-1] != "*"}
        self.bad = {t for t in self.toxic if t[-1] != "*"}
        self.stems = {t[:-1] for t in terms if t[-1] == "*"}
        self.lengths = sorted({len(s) for s in self.stems})

    def fired(self, text: str | None) -> list[int]:
        """The places of the voters that vote on a text."""
        counts = Counter(words_of(text))
        found = self.exact & counts.keys()
        for n in self.lengths:
            found |= {w[:n] + "*" for w in counts if len(w) > n and w[:n] in self.stems}
        hits = sorted(self.place[t] for t in found)
        first = len(self.names) - len(FIXED)
        toxic = [h for h in hits if h < len(self.toxic)]
        bad, n = sum(counts[w] for w in self.bad & counts.keys()), counts.total()
        masked = not self.bad.isdisjoint(unmasked(text))
        fixed = {
            "masked": masked,
            "dense": bad > 1 and 50 * bad >= n,
            "polite": not POLITE.isdisjoint(counts),
            "none": not toxic and not masked,
        }
        return hits + [first + i for i, (name, _) in enumerate(FIXED) if fixed[name]]


def label_sample(labels: DataFrame, *, id_col: str, label_col: str, rows: int = FIT_ROWS, fold: int = 5) -> DataFrame:
    """id and label of at most about ``rows`` training rows: those with crc32(id) mod ``fold`` not 0.

    An id that is labelled both ways says nothing and is left out; one that repeats a label counts once.
    """
    train = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & (F.crc32(F.col(id_col).cast("string").cast("binary")) % fold != 0))
    agreed = train.groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("label"), F.max(label_col).alias("other")).where("label = other")
    agreed = agreed.select("id", F.col("label").cast("int").alias("label"))
    n = agreed.count()
    if n <= rows:
        return agreed
    return agreed.where(F.pmod(F.xxhash64("id", F.lit("fit")), F.lit(1_000_000)) < int(1_000_000 * rows / n))


def text_sample(docs: DataFrame, *, id_col: str, text_col: str, rows: int = VOTE_ROWS, fold: int = 5) -> DataFrame:
    """At most about ``rows`` distinct texts of documents outside the held-out fold, labelled or not; a hash of the text decides."""
    text = F.col(f"`{text_col}`")
    train = docs.where(text.isNotNull() & (F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % fold != 0)).select(text.alias("text"))
    n = train.count()
    if n > rows:
        train = train.where(F.pmod(F.xxhash64("text", F.lit("votes")), F.lit(1_000_000)) < int(1_000_000 * rows / n))
    return train.distinct()


def term_counts(sample: DataFrame) -> DataFrame:
    """term, n0, n1: texts of either label that hold the term; combined on each batch before the exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", BATCH_BYTES):
                counts = (Counter(), Counter())
                for text, label in zip(column_list(batch, "text"), column_list(batch, "label"), strict=True):
                    counts[label].update(terms_of(text))
                terms = list(counts[0].keys() | counts[1].keys())
                yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array([c[t] for t in terms], pa.int64()) for c in counts)], ["term", "n0", "n1"])

    counted = sample.select("text", "label").mapInArrow(run, "term string, n0 long, n1 long")
    return counted.groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _fewest(by_term: dict[str, int], most: int) -> list[str]:
    """The terms that add something: a beginning only if it covers 1.5 times the texts of its best kept word."""
    kept: list[str] = []
    for term, n in sorted(by_term.items(), key=lambda kv: (kv[0][-1] == "*", -len(kv[0]), -kv[1], kv[0])):
        stem = term[:-1]
        if term[-1] == "*" and n < 1.5 * max((by_term[k] for k in kept if k.startswith(stem)), default=0):
            continue
        kept.append(term)
    # words and longer beginnings under a kept beginning add nothing
    stems = tuple(k[:-1] for k in kept if k[-1] == "*")
    kept = [k for k in kept if not any(k != s + "*" and k.startswith(s) and len(k.rstrip("*")) > len(s) for s in stems)]
    return sorted(kept, key=lambda k: (-by_term[k], k))[:most]


def choose_voters(counts: DataFrame, n0: int, n1: int, most: int = VOTERS) -> Voters:
    """Toxic terms (9 of 10 texts toxic) and civil terms (less than half the average share), significantly so."""
    if not n0 or not n1:
        return Voters()
    base = n1 / (n0 + n1)
    a, b = F.col("n1").cast("double"), F.col("n0").cast("double")
    part = lambda x, share: F.when(x > 0, x * F.ln(x / (a + b) / share)).otherwise(0.0)
    counts = counts.where("n0 + n1 >= 3").withColumn("p", part(a, base) + part(b, 1 - base))
    # as many tests as there are terms: a term must stand out by more than the best of so many by chance
    counts = materialize(counts, "toxicity-terms")
    strong = counts.where(F.col("p") >= math.log(max(counts.count(), 1)) + 1)
    chosen = []
    for side in (strong.where((a >= 3) & (a / (a + b) >= 0.9)).withColumn("n", F.col("n1")), strong.where(a / (a + b) <= base / 2).withColumn("n", F.col("n0"))):
        rows = side.orderBy(F.desc("n"), F.desc("p"), "term").collect()
        chosen.append(_fewest({r["term"]: r["n"] for r in rows}, most))
    return Voters(*chosen)


@dataclass
class LabelModel:
    """A generative model of the votes: what each vote says, by itself and where its parent in the forest votes too."""

    prior: float
    parent: np.ndarray
    #: log P(vote | parent's vote, toxic) / P(vote | parent's vote, civil): [voter, parent's vote].
    says: np.ndarray
    #: P(the voter's side | it votes).
    accuracy: np.ndarray
    #: (voter, parent, correlation of their votes given the label).
    links: list[tuple[int, int, float]]

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(toxic | votes) for rows of votes (1: the voter votes, 0: it abstains)."""
        above = np.where(self.parent >= 0, votes[:, np.maximum(self.parent, 0)], 0)
        says = votes * (self.says[:, 0] * (1 - above) + self.says[:, 1] * above)
        logit = math.log(self.prior / (1 - self.prior)) + says.sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def majority_start(votes: np.ndarray, sides: np.ndarray, prior: float) -> np.ndarray:
    """First posteriors: sure for a majority of toxic or of civil votes, the prior without one."""
    balance = np.sign(votes @ sides)
    return np.where(balance > 0, 0.95, np.where(balance < 0, 0.05, prior))


def pair_counts(votes: np.ndarray, post: np.ndarray) -> np.ndarray:
    """Expected counts [voter, vote, other voter, other's vote, label] under posteriors."""
    k = votes.shape[1]
    out = np.zeros((k, 2, k, 2, 2))
    for label, w in ((0, 1 - post), (1, post)):
        for x in (0, 1):
            left = (votes if x else 1 - votes) * w[:, None]
            for y in (0, 1):
                out[:, x, :, y, label] = left.T @ (votes if y else 1 - votes)
    return out


def draw_forest(counts: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, float]]]:
    """Parents of the maximum spanning forest of significant conditional mutual information, and its links.

    Only voters that vote together are linked: of two that exclude each other, neither repeats the other.
    """
    k = counts.shape[0]
    smooth = counts + 0.25
    joint = smooth / smooth.sum(axis=(1, 3), keepdims=True)
    own, other = joint.sum(axis=3, keepdims=True), joint.sum(axis=1, keepdims=True)
    weight = smooth.sum(axis=(1, 3))
    # likelihood ratio statistic over both labels; chi-square with two degrees: 2 log(pairs / 0.01) is the bar
    gain = 2 * ((joint * np.log(joint / (own * other))).sum(axis=(1, 3)) * weight).sum(axis=-1)
    bar = 2 * math.log(max(k * (k - 1) / 2, 1) / 0.01)
    cover = joint[:, 1, :, 1, :] - own[:, 1, :, 0, :] * other[:, 0, :, 1, :]
    spread = np.sqrt(own[:, 1, :, 0, :] * own[:, 0, :, 0, :] * other[:, 0, :, 1, :] * other[:, 0, :, 0, :])
    phi = ((cover / spread) * weight).sum(axis=-1) / weight.sum(axis=-1)
    tree = np.arange(k)

    def root(i: int) -> int:
        while tree[i] != i:
            i = tree[i]
        return i

    near: dict[int, list[int]] = {}
    pairs = [(gain[i, j], i, j) for i in range(k) for j in range(i + 1, k) if gain[i, j] > bar and phi[i, j] > 0]
    for _, i, j in sorted(pairs, reverse=True):
        a, b = root(i), root(j)
        if a != b:
            tree[a] = b
            near.setdefault(i, []).append(j)
            near.setdefault(j, []).append(i)
    parent, links, seen = np.full(k, -1), [], set()
    for start in range(k):
        stack = [start] if start not in seen else []
        seen.add(start)
        while stack:
            i = stack.pop()
            for j in near.get(i, []):
                if j not in seen:
                    seen.add(j)
                    parent[j] = i
                    links.append((j, i, float(phi[j, i])))
                    stack.append(j)
    return parent, links


def estimate(votes: np.ndarray, sides: np.ndarray, post: np.ndarray, prior: float, parent: np.ndarray, links: list[tuple[int, int, float]]) -> LabelModel:
    """The model that posteriors imply."""
    above = np.where(parent >= 0, votes[:, np.maximum(parent, 0)], 0)
    says, trust = np.zeros((votes.shape[1], 2)), np.where(sides > 0, TRUST, prior / 2)
    for state in (0, 1):
        here = above if state else 1 - above
        n1, n0 = post @ here, (1 - post) @ here  # texts of either label with the parent in this state
        c1, c0 = post @ (votes * here), (1 - post) @ (votes * here)
        says[:, state] = np.log((c1 + SMOOTH * trust) / (n1 + 1e-9)) - np.log((c0 + SMOOTH * (1 - trust)) / (n0 + 1e-9))
    says[parent < 0, 1] = says[parent < 0, 0]
    # voters are better than chance: without this, voters that all vote on long texts make a label of their own
    says = np.where(sides[:, None] > 0, np.maximum(says, 0), np.minimum(says, 0))
    toxic = (post @ votes + SMOOTH * prior) / (votes.sum(axis=0) + SMOOTH)
    return LabelModel(prior, parent, says, np.where(sides > 0, toxic, 1 - toxic), links)


def fit_label_model(votes: np.ndarray, sides: np.ndarray, prior: float, rounds: int = 200) -> tuple[LabelModel, np.ndarray]:
    """The model and the posteriors of ``votes`` (rows, voters), by expectation maximisation.

    First without links between voters; then the forest is drawn and the model fitted again with it, so
    that voters that repeat each other do not count twice. Posteriors that still move after ``rounds`` give a warning.
    """
    votes = votes.astype(float)
    post = majority_start(votes, sides, prior)
    parent, links = np.full(votes.shape[1], -1), []
    for attempt in range(2):
        if attempt:
            parent, links = draw_forest(pair_counts(votes, post))
            if not links:
                break
        for _ in range(rounds):
            model = estimate(votes, sides, post, prior, parent, links)
            new = model.posterior(votes)
            moved = float(np.abs(new - post).max(initial=0.0))
            post = new
            if moved < 1e-6:
                break
        else:
            warnings.warn(f"the label model's posteriors still moved by {moved:.2g} after {rounds} rounds", stacklevel=2)
    return model, post


def fit_sparse_logistic(rows: list[np.ndarray], y: np.ndarray, width: int, penalty: float, rounds: int = 500) -> tuple[np.ndarray, float]:
    """Weights and constant of a logistic regression on 0/1 features with soft labels.

    ``rows``: the features that each text has. ``penalty`` times the texts is the price of a weight's size. Only features that are not
    at zero, or would not stay there, are stepped; when these have settled, all are looked at again. Weights that still
    move after ``rounds`` steps give a warning.
    """
    n = len(rows)
    where = np.repeat(np.arange(n, dtype=np.int32), [len(r) for r in rows])
    cells = np.concatenate([np.empty(0, np.int32), *rows], dtype=np.int32, casting="unsafe")
    share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
    w, bias, moved = np.zeros(width), math.log(share / (1 - share)), np.inf
    wrong = (share - y) / n
    while rounds > 0:
        pull = np.abs(_added(cells, wrong, where, width))
        active = (w != 0) | (pull > penalty)
        if moved < 1e-3 and not (active & (w == 0) & (pull > 1.01 * penalty)).any():
            break
        own = active[cells]
        place = (np.cumsum(active) - 1).astype(np.int32)
        part, bias, wrong, moved, used = _proximal_steps(where[own], place[cells[own]], y, w[active], bias, penalty, rounds)
        w = np.zeros(width)
        w[active] = part
        rounds -= used
    else:
        warnings.warn(f"the classifier's weights still moved by {moved:.2g} when steps ran out", stacklevel=2)
    return w, bias


def _added(to: np.ndarray, values: np.ndarray, of: np.ndarray, width: int) -> np.ndarray:
    """``values[of]`` added up by ``to``, a part at a time: the driver holds no copy of all of them."""
    out = np.zeros(width)
    for start in range(0, len(to), 1 << 19):
        part = slice(start, start + (1 << 19))
        out += np.bincount(to[part], weights=values[of[part]], minlength=width)
    return out


def _proximal_steps(where: np.ndarray, cells: np.ndarray, y: np.ndarray, w: np.ndarray, bias: float, penalty: float, rounds: int) -> tuple[np.ndarray, float, np.ndarray, float, int]:
    """Accelerated proximal steps, for each weight of the length that its curvature allows; momentum that points uphill is dropped."""
    n, width = len(y), len(w)
    # along each weight the curvature is at most a quarter of the sum of its texts' features, over the texts
    sizes = np.bincount(where, minlength=n) + 1.0
    steep = np.maximum(0.25 * _added(cells, sizes, where, width) / n, 1e-12)
    steep_bias = 0.25 * float(sizes.mean())
    at, at_bias, momentum, moved, used = w.copy(), bias, 1.0, np.inf, 0
    slopes = lambda v, b: (1 / (1 + np.exp(-np.clip(b + _added(where, v, cells, n), -30, 30))) - y) / n
    while used < rounds and moved >= 1e-3:
        used += 1
        wrong = slopes(at, at_bias)
        step = at - _added(cells, wrong, where, width) / steep
        new, new_bias = np.sign(step) * np.maximum(np.abs(step) - penalty / steep, 0), at_bias - wrong.sum() / steep_bias
        if float(np.dot((at - new) * steep, new - w)) + (at_bias - new_bias) * (new_bias - bias) * steep_bias > 0:
            momentum = 1.0
        after = (1 + math.sqrt(1 + 4 * momentum * momentum)) / 2
        at, at_bias = new + (momentum - 1) / after * (new - w), new_bias + (momentum - 1) / after * (new_bias - bias)
        moved = max(float(np.abs(new - w).max(initial=0.0)), abs(new_bias - bias))
        w, bias, momentum = new, new_bias, after
    return w, bias, slopes(w, bias), moved, used


def cells_of(word: str) -> list[int]:
    """The cells of a word and of its beginnings."""
    terms = [word, *(f"{word[:n]}*" for n in BEGINNINGS if len(word) > n)]
    return [zlib.crc32(t.encode()) % CELLS for t in terms]


class Cells:
    """Distinct cells of texts among those wanted (None: all); a word's cells are looked up once by a worker."""

    def __init__(self, wanted: set[int] | None = None):
        self.wanted, self.known = wanted, {}

    def __call__(self, text: str | None) -> set[int]:
        out: set[int] = set()
        if len(self.known) > 200_000:
            self.known.clear()
        for word in set(words_of(text)) | unmasked(text):
            held = self.known.get(word)
            if held is None:
                held = self.known[word] = tuple(c for c in cells_of(word) if self.wanted is None or c in self.wanted)
            if held:
                out.update(held)
        return out


@dataclass
class ToxicityModel:
    """Weights of cells that are not zero, and the constant; the voters and the label model it was trained by."""

    weights: dict[int, float] = field(default_factory=dict)
    constant: float = -math.log(3)
    voters: Voters = field(default_factory=Voters)
    labels: LabelModel | None = None


def votes_on(texts: DataFrame, voters: Voters) -> DataFrame:
    """text and hits: the places of the voters that vote on it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", BATCH_BYTES):
                hits = [voters.fired(t) for t in column_list(batch, "text")]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hits, pa.list_(pa.int32()))], ["text", "hits"])

    return texts.select("text").mapInArrow(run, "text string, hits array<int>")


def vote_matrix(hits: list, width: int) -> np.ndarray:
    votes = np.zeros((len(hits), width), np.float32)
    for i, hit in enumerate(hits):
        votes[i, hit] = 1
    return votes


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = FIT_ROWS, texts: int = VOTE_ROWS, fold: int = 5) -> ToxicityModel:
    """Choose voters by at most about ``rows`` labelled rows, fit on the votes on at most about ``texts`` texts without their labels.

    Both leave the held-out fold out. Of rows that share an id the least text is read, and equal texts count once; those
    labelled both ways say nothing. Without labels of both kinds, or if no term stands out, nothing is learned: every text
    scores 0.25, so nothing is called toxic.
    """
    ids = label_sample(labels, id_col=id_col, label_col=label_col, rows=rows, fold=fold)
    # the labels sampled are bounded by ``rows``, so they may be broadcast
    sample = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(ids), "id")
    sample = sample.groupBy("id", "label").agg(F.min("text").alias("text"))
    sample = sample.groupBy("text").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other")
    sample = materialize(sample.select("text", "label"), "toxicity-sample")
    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    voters = choose_voters(term_counts(sample), n0, n1)
    if not voters.toxic:
        return ToxicityModel(voters=voters)
    voted = materialize(votes_on(text_sample(docs, id_col=id_col, text_col=text_col, rows=texts, fold=fold), voters), "toxicity-votes")
    return learn(voted, voters, n1 / (n0 + n1))


def learn(voted: DataFrame, voters: Voters, prior: float) -> ToxicityModel:
    """The label model of the votes and the classifier on its posteriors; no label is given."""
    k = len(voters.names)
    # places of votes alone, one short list for each of a bounded number of texts
    got = voted.select("hits", F.xxhash64("text").alias("order")).toArrow().sort_by([("order", "ascending")])
    model, _ = fit_label_model(vote_matrix(got.column("hits").to_pylist(), k), voters.sides, prior)

    def believe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Cells()
        for whole in batches:
            for batch in slices(whole, "text", BATCH_BYTES):
                post = model.posterior(vote_matrix(column_list(batch, "hits"), k))
                yield pa.RecordBatch.from_arrays([pa.array(post, pa.float64()), pa.array([sorted(own(t)) for t in column_list(batch, "text")], pa.list_(pa.int32()))], ["post", "cells"])

    believed = materialize(voted.mapInArrow(believe, "post double, cells array<int>"), "toxicity-posteriors")
    total = believed.agg(F.count(F.lit(1)).alias("n"), F.avg("post").alias("share")).first()
    # a cell whose pull at weight zero is under half the penalty is left out
    pull = F.abs(F.sum(F.col("post") - total["share"])) / total["n"]
    strong = believed.select("post", F.explode("cells").alias("cell")).groupBy("cell").agg(pull.alias("pull")).where(F.col("pull") >= PENALTY / 2)
    chosen = sorted(r["cell"] for r in strong.select("cell").collect())
    wanted = np.array(chosen, dtype=np.int64)

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [np.flatnonzero(np.isin(wanted, c, assume_unique=True)) for c in column_list(batch, "cells")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.list_(pa.int32()))], ["post", "x"])

    del got
    table = believed.mapInArrow(narrow, "post double, x array<int>").toArrow()
    lists = table.column("x").combine_chunks()
    # views of one array, not a list for each text
    rows = np.split(lists.values.to_numpy(), lists.offsets.to_numpy()[1:-1]) if len(lists) else []
    weights, constant = fit_sparse_logistic(rows, table.column("post").to_numpy(), len(wanted), PENALTY)
    return ToxicityModel({int(wanted[i]): float(weights[i]) for i in np.flatnonzero(weights)}, constant, voters, model)


def score_toxicity(docs: DataFrame, model: ToxicityModel, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on) of every whole text.

    Null and empty texts score as texts without terms. Repeated rows score alike; an empty table
    gives an empty result. Very long texts are read whole, once. The text itself may be among ``keep``.
    Kept columns that are called like an added one are renamed to ``input_<name>``.
    """
    named = set_aside(docs.select(*[F.col(f"`{c}`") for c in keep]), ("score", "predicted"))
    text, names = fresh(named, "_text"), named.columns
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)], F.col(f"`{text_col}`").alias(text))
    fields = ", ".join(f"`{n}` {t}" for n, t in named.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Cells(set(model.weights))
        for whole in batches:
            for batch in slices(whole, text, BATCH_BYTES):
                logits = np.array([model.constant + sum(map(model.weights.__getitem__, sorted(own(t)))) for t in column_list(batch, text)])
                scores = 1 / (1 + np.exp(-np.clip(logits, -30, 30)))
                arrays = [batch.column(i) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32))], [*names, "score", "predicted"])

    return rows.mapInArrow(run, f"{fields}, score double, predicted int")


def keep_civil(docs: DataFrame, model: ToxicityModel, *, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model does not call toxic, with the columns of ``docs``."""
    scored = score_toxicity(docs, model, text_col=text_col, keep=tuple(docs.columns)).where("predicted = 0")
    return scored.select(*[F.col(f"`{own}`").alias(c) for own, c in zip(scored.columns, docs.columns, strict=False)])
