r"""Quality rules: a linear-chain conditional random field over the lines of a text.

Every line (split at \n) is a vector of features; Viterbi decoding marks it content or boilerplate; a text is kept if
lines marked as content hold at least `share` of its word characters. Base rules come first: a text of under 20 words,
or with over 30 % of its words in 8-word windows found twice or more, fails.

The field is trained here. Labels are of texts, not of lines, so the marks of a training text are latent: a label agrees
with each line of its own mark by a factor exp(`AGREE`), and the likelihood of the labels, summed over all marks, is
ascended. A text labelled good may thus hold boilerplate lines and the other way round, and what the transition weights
(one for staying in each mark) learn is how long stretches of one mark are. All weights are shrunk (`decay`); none is
held to a range.

The sample is bounded: the `most_docs` (1,000) labelled texts of each class with the smallest seeded hash of the id, cut
into pieces of up to `piece_lines` lines, of which the `most_pieces` (8,000) with the smallest seeded hash are used.
Without labels of both classes, fixed starting weights are used. Rules and decoding cover every row and every whole text.

Edge cases. Null and blank texts have no words: base_failed, not kept. Only \n splits lines; lines without a word carry
no features and follow their neighbours. Repeated rows are judged each. Extra columns are kept unless named like a
result column; a null id is judged like any other. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

RESULT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share", "kept")
FEATURES = ("bias", "symbols", "capitals", "digits", "bangs", "repeats", "long_words", "log_words")
#: emission weights (content minus boilerplate) and transition weights (staying in boilerplate, in content) before training
START = np.array([2.0, -12.0, -6.0, -4.0, -10.0, -4.0, 0.0, 0.0, 0.5, 0.5])
AGREE = 2.0

_IS = np.zeros((6, 256), np.uint8)
_IS[0, list(b"#*$%&|<>")] = 1
_IS[1, 65:91] = 1
_IS[2, 48:58] = 1
_IS[3, list(b"!")] = 1
_IS[4] = (np.arange(256) & 0xC0) != 0x80
_IS[4, [9, 10, 11, 12, 13, 32]] = 0
_IS[5, [9, 10, 11, 12, 13, 32]] = 1


class Texts:
    """Counts of a batch of texts: per document, and per line."""

    def __init__(self, col: pa.Array, window: int = 8):
        data, off = C.raw(col)
        w = C.Words(col)
        docs, words = len(off) - 1, w.size()
        self.n_words = words
        # lines: one more than the line ends of each document
        ends = np.flatnonzero(data == 10)
        per = np.searchsorted(ends, off)
        count = np.diff(per) + 1
        self.line = np.concatenate([[0], np.cumsum(count)])
        begin = np.empty(self.line[-1], np.int64)
        heads = np.zeros(self.line[-1], bool)
        heads[self.line[:-1]] = True
        begin[heads], begin[~heads] = off[:-1], ends + 1
        stop = np.empty_like(begin)
        tails = np.zeros(self.line[-1], bool)
        tails[self.line[1:] - 1] = True
        stop[tails], stop[~tails] = off[1:], ends
        sums = [np.concatenate([[0], np.cumsum(_IS[k][data], dtype=np.int64)]) for k in range(6)]
        per_line = [s[stop] - s[begin] for s in sums]
        symbols, capitals, digits, bangs, chars, _ = per_line
        self.chars = chars
        self.word_chars, self.n_symbols = (sums[k][off[1:]] - sums[k][off[:-1]] for k in (4, 0))
        # words by line
        solid = _IS[5][data] == 0
        first = np.flatnonzero(solid & np.concatenate([[True], ~solid[:-1]])[: len(solid)]) if len(data) else np.zeros(0, np.int64)
        extra = np.zeros(len(data), bool)
        inner = off[1:-1]
        inner = inner[(inner > 0) & (inner < len(data))]
        extra[inner] = solid[inner] & solid[inner - 1]  # a word that begins at a document's start
        if extra.any():
            first = np.union1d(first, np.flatnonzero(extra))
        at = np.searchsorted(first, np.stack([begin, stop]))
        self.line_words = at[1] - at[0]
        # repeated windows
        v8 = C.load8(w.buf)
        names = C.hash_ranges(v8, w.start, w.end - w.start)
        doc_of = np.repeat(np.arange(docs), words)
        self.covered = self._repeats(names, doc_of, w.doc, window)
        total = np.concatenate([[0], np.cumsum(self.covered)])
        self.n_repeat_words = total[w.doc[1:]] - total[w.doc[:-1]]
        by_line = np.concatenate([[0], np.cumsum(self.line_words)])
        repeated = total[by_line[1:]] - total[by_line[:-1]]
        self.n_dup_lines = self._dup_lines(data, begin, stop)
        n = np.maximum(chars, 1)
        k = np.maximum(self.line_words, 1)
        self.x = np.stack([np.ones(len(n)), symbols / n, capitals / n, digits / n, bangs / n, repeated / k, np.minimum(n / k, 40) / 10, np.log1p(self.line_words) / 5], axis=1)
        self.x[self.line_words == 0] = 0

    @staticmethod
    def _repeats(names: np.ndarray, doc_of: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
        """Words in k-word windows that their document has twice or more."""
        n = len(names)
        covered = np.zeros(n, bool)
        if n < k:
            return covered
        h = C.mix(doc_of[: n - k + 1].astype(np.uint64) + np.uint64(1))
        for j in range(k):
            h = C.mix(h * np.uint64(0x2545F4914F6CDD1D) + names[j : n - k + 1 + j])
        inside = doc_of[: n - k + 1] == doc_of[k - 1 :]
        at = np.flatnonzero(inside)
        h = h[at]
        order = np.argsort(h)
        same = h[order[1:]] == h[order[:-1]]
        twice = np.zeros(len(h), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, at[twice], 1)
        np.add.at(edge, at[twice] + k, -1)
        return np.cumsum(edge)[:n] > 0

    def _dup_lines(self, data: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.n_words), np.int64)
        text = data.tobytes()
        full = self.line_words > 0
        for d in np.flatnonzero(np.add.reduceat(full.astype(np.int64), self.line[:-1]) > 1) if len(out) else []:
            rows = np.arange(self.line[d], self.line[d + 1])
            rows = rows[full[rows]]
            lines = [text[a:b] for a, b in zip(begin[rows].tolist(), stop[rows].tolist(), strict=True)]
            out[d] = len(lines) - len(set(lines))
        return out


def _pad(line: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For step t = 0, 1, ...: the documents (longest first) that have a line t, and those lines."""
    n = np.diff(line)
    order = np.argsort(-n, kind="stable")
    alive = np.searchsorted(-n[order], -np.arange(n.max(initial=0)), side="left")
    for t, k in enumerate(alive):
        yield order[:k], line[:-1][order[:k]] + t


def viterbi(score: np.ndarray, line: np.ndarray, stay: np.ndarray) -> np.ndarray:
    """The best marks (1: content) of each document's lines. score: content minus boilerplate, per line; stay: what
    staying in boilerplate and in content adds; ties: content."""
    docs = len(line) - 1
    a, b = np.zeros(docs), np.zeros(docs)  # best scores that end in boilerplate, content
    back = np.zeros((len(score), 2), bool)  # the state before is content
    steps = list(_pad(line))
    for t, (d, rows) in enumerate(steps):
        if t == 0:
            a[d], b[d] = 0, score[rows]
            continue
        x, y = a[d], b[d]
        back[rows, 0], back[rows, 1] = y > x + stay[0], y + stay[1] >= x
        a[d] = np.maximum(x + stay[0], y)
        b[d] = np.maximum(y + stay[1], x) + score[rows]
    mark = np.zeros(len(score), bool)
    state = b >= a
    for t in range(len(steps) - 1, -1, -1):
        d, rows = steps[t]
        mark[rows] = state[d]
        if t:
            state[d] = np.where(state[d], back[rows, 1], back[rows, 0])
    return mark


def forward_backward(score: np.ndarray, line: np.ndarray, stay: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per line the marginal of content; per document the expected numbers of steps that stay in boilerplate and in
    content, and the logarithm of the sum over all marks."""
    docs = len(line) - 1
    f, g = np.zeros((len(score), 2)), np.zeros((len(score), 2))
    now = np.zeros((docs, 2))
    steps = list(_pad(line))
    s = np.stack([np.zeros(len(score)), score], axis=1)
    go = lambda x: np.stack([np.logaddexp(x[:, 0] + stay[0], x[:, 1]), np.logaddexp(x[:, 1] + stay[1], x[:, 0])], axis=1)
    for t, (d, rows) in enumerate(steps):
        now[d] = (go(now[d]) if t else now[d]) + s[rows]
        f[rows] = now[d]
    z = np.logaddexp(now[:, 0], now[:, 1])
    after = np.zeros((docs, 2))
    same = np.zeros((docs, 2))
    for t in range(len(steps) - 1, -1, -1):
        d, rows = steps[t]
        g[rows] = after[d]
        y = after[d] + s[rows]
        if t:
            same[d] += np.exp(f[rows - 1] + stay + y - z[d][:, None])
        after[d] = go(y)
    return np.exp(f[:, 1] + g[:, 1] - np.repeat(z, np.diff(line))), same, z


def train(x: np.ndarray, line: np.ndarray, label: np.ndarray, rounds: int = 200, rate: float = 0.3, decay: float = 3e-5) -> np.ndarray:
    """Weights (of FEATURES, then the two of staying) by gradient ascent with steps scaled by the gradients' running
    size; both classes weigh the same."""
    w = START.copy()
    if not len(label) or label.min() == label.max():
        return w
    agree = AGREE * (x[:, 0] > 0)
    total = np.add.reduceat(agree, line[:-1])
    weight = np.where(label > 0, 0.5 / (label > 0).sum(), 0.5 / (label == 0).sum())
    mean, size = np.zeros(len(w)), np.zeros(len(w))
    for i in range(1, rounds + 1):
        score = x @ w[:-2]
        p1, same1, z1 = forward_backward(score + agree, line, w[-2:])
        p0, same0, z0 = forward_backward(score - agree, line, w[-2:])
        good = 1 / (1 + np.exp(np.clip(z0 + total - z1, -700, 700)))
        pull = weight * (label - good)
        grad = np.append(x.T @ ((p1 - p0) * np.repeat(pull, np.diff(line))), pull @ (same1 - same0)) - decay * w
        mean, size = 0.9 * mean + 0.1 * grad, 0.99 * size + 0.01 * grad**2
        w = w + rate * mean / (1 - 0.9**i) / (np.sqrt(size / (1 - 0.99**i)) + 1e-8)
    return w


def sample_features(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, most_docs: int, piece_lines: int = 200, most_pieces: int = 8000, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of the bounded sample of labelled texts: rows, line offsets and labels of its pieces."""
    one = labels.where(F.col("quality").isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min("quality").cast("int").alias("q"))
    mark = F.xxhash64(F.lit(seed), F.col(id_col))
    picked = one.where("q = 1").orderBy(mark, id_col).limit(most_docs).unionByName(one.where("q = 0").orderBy(mark, id_col).limit(most_docs))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked.select(F.col(id_col).alias("id"), "q")), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in C.slices(batch, "text", 1 << 20):
                t = Texts(part.column("text"))
                pieces = -(-np.diff(t.line) // piece_lines)
                row = np.repeat(np.arange(len(pieces)), pieces)
                no = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                begin = t.line[row] + no * piece_lines
                end = np.minimum(begin + piece_lines, t.line[row + 1])
                x = t.x.astype(np.float32)
                blobs = [x[a:b].tobytes() for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([part.column("id").take(at), part.column("q").take(at), pa.array(no), pa.array(blobs, pa.binary())], names=["id", "q", "piece", "x"])

    kinds = [("id", docs.schema[id_col].dataType), ("q", T.IntegerType()), ("piece", T.LongType()), ("x", T.BinaryType())]
    pieces = rows.mapInArrow(run, T.StructType([T.StructField(n, k) for n, k in kinds]))
    # one row of an id and place, so that repeated rows neither reach the driver nor make the choice depend on the order of tasks
    once = pieces.groupBy("id", "q", "piece").agg(F.min("x").alias("x"))
    got = sorted(once.orderBy(F.xxhash64(F.lit(seed), "id", "piece"), "id", "piece").limit(most_pieces).collect(), key=lambda r: (r["id"], r["piece"]))
    xs = [np.frombuffer(r["x"], np.float32).reshape(-1, len(FEATURES)).astype(float) for r in got]
    x = np.concatenate(xs) if xs else np.zeros((0, len(FEATURES)))
    return x, np.concatenate([[0], np.cumsum([len(v) for v in xs])]).astype(np.int64), np.array([r["q"] for r in got])


def judge(docs: DataFrame, labels: DataFrame | None, id_col: str = "doc_id", text_col: str = "text", share: float = 0.5, most_docs: int = 1000, drop_text: bool = False) -> DataFrame:
    """docs with n_words, the base counts, base_failed, content_share and kept."""
    w = train(*sample_features(docs, labels, id_col, text_col, most_docs)) if labels is not None else START
    keep = [c for c in docs.columns if c.lower() not in RESULT and not (drop_text and c == text_col)]
    long, flag = T.LongType(), T.BooleanType()
    schema = C.plus(docs.select(*keep).schema, *((c, long) for c in RESULT[:5]), ("base_failed", flag), ("content_share", T.DoubleType()), ("kept", flag))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in C.slices(batch, text_col, 1 << 20):
                t = Texts(part.column(text_col))
                failed = (t.n_words < 20) | (100 * t.n_repeat_words > 30 * t.n_words)
                content = content_share(t, w)
                cols = {c: pa.array(getattr(t, c).astype(np.int64)) for c in RESULT[:5]}
                cols |= {"base_failed": pa.array(failed), "content_share": pa.array(content), "kept": pa.array(~failed & (content >= share))}
                yield C.with_columns(part, schema.names, cols)

    return docs.mapInArrow(run, schema)


def content_share(t: Texts, w: np.ndarray) -> np.ndarray:
    """Of each text, the share of word characters in lines that decoding marks as content."""
    marks = viterbi(t.x @ w[:-2], t.line, w[-2:])
    total = np.concatenate([[0], np.cumsum(t.chars * marks)])
    return (total[t.line[1:]] - total[t.line[:-1]]) / np.maximum(t.word_chars, 1)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs, C.read_table(spark, sf_dir, "labels"), drop_text=True).select("doc_id", *RESULT)
