"""Quality rules: gradient-boosted trees over document statistics.

Each document becomes a row of statistics (below), computed on its whole text.  Two fixed
rules come first; the verdict on the rest is that of boosted trees, trained here on labelled
documents with second-order histogram splits.  Some features carry a monotonic constraint:
more symbols, repetition or capitals never raise a score.  The trees are flattened into numpy
node arrays (feature, threshold, left, right, value) and scored for all rows of a batch at
once, level by level.

Training is bounded: at most ``SAMPLE`` labelled documents, those with the least hash of their
id, are brought to the driver as ``len(FEATURES)`` numbers each.  Scoring is a scan without a
shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .block import _WS, U64, Block, Rolling, extended, mix, slices

BLOCK_BYTES = 2 << 20
SAMPLE = 20_000
REPEAT = 8
#: Features, and +1 or -1 where the score may only rise or fall with them.
FEATURES = {
    "log_words": 0, "mean_word": 0, "longest_word": 0, "symbol_rate": -1, "pipe_rate": 0, "upper_rate": -1, "digit_rate": 0,
    "mark_rate": 0, "shout_rate": -1, "repeat_rate": -1, "dup_line_rate": -1, "distinct_rate": 1, "line_words": 0, "stop_rate": 0,
}
# The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
_CLASSES = {
    "symbol": SYMBOLS, "pipe": b"|", "upper": bytes(range(65, 91)), "digit": b"0123456789", "mark": b",;:?\"'()-", "shout": b"!", "stop": b".", "line": b"\n",
}


def _is(characters: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters)] = True
    return out


_TABLES = {k: _is(v) for k, v in _CLASSES.items()}
_TABLES["word_char"] = ~_WS & ((np.arange(256) & 0xC0) != 0x80)


def _dup_lines(document: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    seen, n = set(), 0
    for line in document.split(b"\n"):
        if line in seen:
            n += bool(line.strip())
        else:
            seen.add(line)
    return n


def statistics(block: Block) -> dict[str, np.ndarray]:
    """Counts of each document of a block."""
    out = {"n_words": np.diff(block.first)}
    for name, table in _TABLES.items():
        total = np.concatenate(([0], np.cumsum(table[block.data], dtype=np.int64)))
        out[name] = total[block.offsets[1:]] - total[block.offsets[:-1]]
    out["n_dup_lines"] = np.array([_dup_lines(block.document(k)) if out["line"][k] else 0 for k in range(block.n_docs)], np.int64)
    words = block.hashes()
    place = mix(words + mix(block.doc.astype(U64) + U64(1)))
    order = np.argsort(place)
    new = np.ones(len(order), bool)
    new[1:] = place[order][1:] != place[order][:-1]
    out["distinct"] = np.bincount(block.doc[order[new]], minlength=block.n_docs)
    start = np.arange(block.n_words)
    start = start[start + REPEAT <= block.first[1:][block.doc]]
    value = mix(Rolling(words).of(start, start + REPEAT) + mix(block.doc[start].astype(U64) + U64(1)))
    order = np.argsort(value)
    same = np.zeros(len(order) + 1, bool)
    same[1:-1] = value[order][1:] == value[order][:-1]
    again = start[order[same[1:] | same[:-1]]]
    edge = np.zeros(block.n_words + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + REPEAT, -1)
    covered = np.concatenate(([0], np.cumsum(np.cumsum(edge[:-1]) > 0)))
    out["n_repeat_words"] = covered[block.first[1:]] - covered[block.first[:-1]]
    longest = np.zeros(block.n_docs, np.int64)
    np.maximum.at(longest, block.doc, block.ends - block.starts)
    out["longest"] = longest
    return out


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    """A row of FEATURES for each document."""
    words = np.maximum(s["n_words"], 1)
    chars = np.maximum(s["word_char"], 1)
    lines = s["line"] + 1
    return np.stack([
        np.log1p(s["n_words"]), s["word_char"] / words, np.log1p(s["longest"]), s["symbol"] / chars, s["pipe"] / words, s["upper"] / chars, s["digit"] / chars,
        s["mark"] / words, s["shout"] / words, s["n_repeat_words"] / words, s["n_dup_lines"] / lines, s["distinct"] / words, s["n_words"] / lines, s["stop"] / words,
    ], 1).astype(np.float64)


@dataclass
class Forest:
    """Trees as flat node arrays; a leaf is its own child."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float
    cut: float = float("-inf")

    def margin(self, x: np.ndarray) -> np.ndarray:
        node = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[row, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return self.base + self.value[node].sum(1)

    def keeps(self, x: np.ndarray) -> np.ndarray:
        return self.margin(x) >= self.cut if len(self.roots) else np.ones(len(x), bool)


def fit(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: float = 5.0) -> Forest:
    """Boosted trees for logistic loss with monotonic constraints.

    A split on a constrained feature is taken only if its children's values are in order, and
    their middle bounds all values below either child, so the whole function is monotonic.
    """
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], 1)  # bin b: value <= edge b
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    score = np.full(len(y), base)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def leaf(v: float) -> int:
        k = len(feature)
        feature.append(0)
        threshold.append(0.0)
        left.append(k)
        right.append(k)
        value.append(v)
        return k

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        gs, hs = g[rows].sum(), h[rows].sum()
        here = leaf(rate * float(np.clip(-gs / (hs + ridge), low, high)))
        if level == depth:
            score[rows] += value[here]
            return here
        best = (1e-6, -1, 0, 0.0, 0.0)
        for f in range(x.shape[1]):
            if not len(edges[f]):
                continue
            gl = np.cumsum(np.bincount(binned[rows, f], g[rows], len(edges[f]) + 1))[:-1]
            hl = np.cumsum(np.bincount(binned[rows, f], h[rows], len(edges[f]) + 1))[:-1]
            gr, hr = gs - gl, hs - hl
            vl, vr = np.clip(-gl / (hl + ridge), low, high), np.clip(-gr / (hr + ridge), low, high)
            gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - gs**2 / (hs + ridge)
            ok = (hl >= least) & (hr >= least)
            if monotone[f]:
                ok &= monotone[f] * (vr - vl) >= 0
            gain = np.where(ok, gain, 0)
            b = int(gain.argmax())
            if gain[b] > best[0]:
                best = (gain[b], f, b, vl[b], vr[b])
        _, f, b, vl, vr = best
        if f < 0:
            score[rows] += value[here]
            return here
        middle = (vl + vr) / 2
        left_low, left_high, right_low, right_high = low, high, low, high
        if monotone[f] > 0:
            left_high, right_low = middle, middle
        elif monotone[f] < 0:
            left_low, right_high = middle, middle
        goes = binned[rows, f] <= b
        feature[here], threshold[here] = f, float(edges[f][b])
        left[here] = grow(rows[goes], g, h, level + 1, left_low, left_high)
        right[here] = grow(rows[~goes], g, h, level + 1, right_low, right_high)
        return here

    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), 0, -np.inf, np.inf))
    arrays = (np.array(feature, np.int32), np.array(threshold), np.array(left, np.int32), np.array(right, np.int32), np.array(value))
    return Forest(*arrays, np.array(roots, np.int32), depth, base)


def none() -> Forest:
    """The verdict without labels: everything is kept."""
    empty = np.zeros(0, np.int32)
    return Forest(empty, np.zeros(0), empty, empty, np.zeros(0), empty, 0, 0.0)


def _rows(column: str):
    names = list(FEATURES)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column, BLOCK_BYTES):
            x = features(statistics(Block(batch.column(column))))
            out = batch.drop_columns([column])
            for k, name in enumerate(names):
                out = out.append_column(name, pa.array(x[:, k]))
            yield out

    return run


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, keep: float = 0.995, id_col: str = "doc_id", text_col: str = "text") -> Forest:
    """Trees from ``labels(doc_id, quality)``, at most ``sample`` of them.

    Rows with a null id or label are left out; an id labelled twice counts as good if any
    label says so.  A fifth of the sample is held out to place the cut, so that ``keep`` of
    the good documents stay; without good ones held out, all of the sample places it.  Of rows
    that share a labelled id the one with the smallest hash of its text is taken.  Labels of one
    kind, or none at all, say nothing, and everything is kept.
    """
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("quality").alias("_y"))
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    slim = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    met = slim.join(F.broadcast(chosen), "_id")  # at most `sample` pairs of numbers
    met = met.groupBy("_id", "_y").agg(F.min_by("_text", F.struct(F.xxhash64("_text"), "_text")).alias("_text"))
    schema = extended(met.drop("_text").schema, **dict.fromkeys(FEATURES, "double"))
    data = met.mapInArrow(_rows("_text"), schema).toArrow().sort_by([(c, "ascending") for c in ("_id", *FEATURES)])
    x, y = np.stack([data[c].to_numpy() for c in FEATURES], 1), data["_y"].to_numpy().astype(np.float64)
    if len(np.unique(y > 0)) < 2:
        return none()
    y = (y > 0).astype(np.float64)
    held = mix(data["_id"].to_numpy().view(U64)) % U64(5) == 0
    if not (held & (y > 0)).any() or len(np.unique(y[~held])) < 2:
        held[:] = False
    forest = fit(x[~held], y[~held], np.array(list(FEATURES.values())))
    good = np.sort(forest.margin(x[(held | ~held.any()) & (y > 0)]))
    forest.cut = min(0.0, float(good[int((1 - keep) * len(good))]))
    return forest


def _judge(column: str, forest: Forest):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column, BLOCK_BYTES):
            s = statistics(Block(batch.column(column)))
            x = features(s)
            failed = (s["n_words"] < 20) | (100 * s["n_repeat_words"] > 30 * s["n_words"])
            margin = forest.margin(x) if len(forest.roots) else np.zeros(len(x))
            out = batch
            for name, value in (("n_words", s["n_words"]), ("word_chars", s["word_char"]), ("n_symbols", s["symbol"]), ("n_dup_lines", s["n_dup_lines"]), ("n_repeat_words", s["n_repeat_words"])):
                out = out.append_column(name, pa.array(value, pa.int64()))
            out = out.append_column("base_failed", pa.array(failed)).append_column("quality_score", pa.array(1 / (1 + np.exp(-margin))))
            yield out.append_column("kept", pa.array(~failed & forest.keeps(x)))

    return run


def _keep(column: str, forest: Forest):
    judge_all = _judge(column, forest)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column, BLOCK_BYTES):
            verdict = next(judge_all([pa.record_batch({column: batch.column(column)})]))
            yield batch.filter(verdict.column("kept"))

    return run


_ADDED = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean", "quality_score": "double", "kept": "boolean"}


def judge(docs: DataFrame, forest: Forest, text_col: str = "text") -> DataFrame:
    """``docs`` with counts, base_failed, quality_score and kept added.

    A null text counts as empty, which fails the base rules.  Columns of these names are
    replaced.  Every row gets its own verdict, repeated ones the same.
    """
    docs = docs.drop(*_ADDED)
    return docs.mapInArrow(_judge(text_col, forest), extended(docs.schema, **_ADDED))


def keep_good(docs: DataFrame, forest: Forest, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, columns unchanged."""
    return docs.mapInArrow(_keep(text_col, forest), docs.schema)
