"""Document quality from a linear-chain conditional random field over its lines.

Every line is labelled good or bad. Node scores come from features of the line
and of its two neighbours, edge scores tie neighbouring labels, and
forward-backward gives each line's marginal probability of being good. The
length-weighted mean of the marginals, in log-odds, is calibrated into the
document's score.

Training sees document labels only, so line labels are hidden: a line agrees
with its document's label but for a chance of NOISE, and the field is fitted by
gradient ascent on the likelihood of the document labels, summed over all line
labellings. That gradient is the difference of two forward-backward passes,
one with the document's label as evidence on every line and one without, for
line labels and pairs of neighbours alike. Lines of one document may so differ,
and the edges learn how labels follow each other. The fit takes at most about
TRAIN_DOCS labelled documents and TRAIN_CHARS characters of them outside the
evaluation fold (chosen by a hash of the id; classes weigh equally). A chain
longer than CHAIN lines is scored in windows that overlap by CONTEXT lines, so
memory stays bounded; every line is scored.

Defined results: null or empty text has one empty line and gets that line's
score; documents without an id or label take no part in training; with no
labels, or of one class only, every score is the share of label 1 (0.5 without
labels); repeated labels of a document all count; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritext.llm.common import chunks, held_out, table

#: Bounds of the training sample, which the driver holds.
TRAIN_DOCS, TRAIN_CHARS = 4000, 30_000_000
#: Chance that a line is unlike its document's label.
NOISE = 0.2
#: Lines of a training document that are used; longer ones are cut into chains and each chain counts.
CHAIN, CONTEXT = 512, 16
STEPS, RATE, DECAY, EDGE_DECAY = 150, 0.15, 1e-3, 1e-2
THRESHOLD = 0.3
#: Kinds of characters that are counted: letter case, digits, and marks by how prose and clutter use them.
_KINDS = {"upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": "0123456789", "stop": ".,;:", "mark": "!?", "pipe": "|\t", "clutter": "%&*#$@^~_+=<>\\/{}[]", "space": " "}
N_LINE = 14
N_FEATURES = 3 * N_LINE + 1


def _kinds() -> np.ndarray:
    lookup = np.zeros(256, dtype=np.int64)
    for i, chars in enumerate(_KINDS.values(), 1):
        for c in chars:
            lookup[ord(c)] = i
    return lookup


_LOOKUP = _kinds()


def line_features(lines: list[str]) -> np.ndarray:
    """One row of N_LINE features in about [0, 1] for each line."""
    raw = [x.encode("utf-8", "replace") for x in lines]
    size = np.array([len(x) for x in raw], dtype=np.int64)
    flat = _LOOKUP[np.frombuffer(b"".join(raw), dtype=np.uint8)]
    line = np.repeat(np.arange(len(lines)), size)
    kinds = np.bincount(line * 8 + flat, minlength=8 * len(lines)).reshape(-1, 8).astype(float)
    words = [x.split() for x in lines]
    n = np.array([len(w) for w in words], dtype=float)
    distinct = np.array([len(set(w)) for w in words], dtype=float)
    short = np.array([sum(map(_is_short, w)) for w in words], dtype=float)
    per = np.maximum(size, 1)[:, None]
    out = np.zeros((len(lines), N_LINE))
    out[:, :7] = np.minimum(kinds[:, 1:8] / per * 4, 1.0)
    out[:, 7] = np.minimum(n / 50, 1.0)
    out[:, 8] = distinct / np.maximum(n, 1)
    out[:, 9] = short / np.maximum(n, 1)
    out[:, 10] = np.minimum(size / np.maximum(n, 1) / 20, 1.0)
    out[:, 11] = n == 0
    out[:, 12] = n < 4
    out[:, 13] = [1.0 if x[-1:] in ".!?" and x else 0.0 for x in lines]
    return out


def _is_short(word: str) -> bool:
    return len(word) <= 3


def features(lines: list[str]) -> np.ndarray:
    """Features of a line, of the line before, of the line after, and a constant."""
    own = line_features(lines)
    gap = np.zeros((1, N_LINE))
    return np.hstack([own, np.vstack([gap, own[:-1]]), np.vstack([own[1:], gap]), np.ones((len(own), 1))])


def _logaddexp_rows(a: np.ndarray) -> np.ndarray:
    m = a.max(-1)
    return m + np.log(np.exp(a - m[..., None]).sum(-1))


def forward_backward(node: np.ndarray, edge: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of padded chains. node: chains x lines x 2 scores, edge: 2 x 2, mask: chains x lines.

    Returns the label marginals, each chain's expected edge counts (chains x 2 x 2) and its log partition sum."""
    chains, lines, _ = node.shape
    alpha, beta = np.zeros_like(node), np.zeros_like(node)
    alpha[:, 0] = node[:, 0]
    for t in range(1, lines):
        step = _logaddexp_rows(alpha[:, t - 1, None, :] + edge.T[None]) + node[:, t]
        alpha[:, t] = np.where(mask[:, t, None], step, alpha[:, t - 1])
    for t in range(lines - 2, -1, -1):
        step = _logaddexp_rows(edge[None] + (node[:, t + 1] + beta[:, t + 1])[:, None, :])
        beta[:, t] = np.where(mask[:, t + 1, None], step, 0.0)
    total = _logaddexp_rows(alpha + beta)
    marginal = np.exp(alpha + beta - total[..., None])
    pairs = alpha[:, :-1, :, None] + edge[None, None] + (node + beta)[:, 1:, None, :] - total[:, 1:, None, None]
    both = (np.exp(np.where(mask[:, 1:, None, None], pairs, -np.inf))).sum(1)
    return marginal * mask[..., None], both, total[:, 0]


def likelihood(node: np.ndarray, edge: np.ndarray, x: np.ndarray, mask: np.ndarray, label: np.ndarray, per: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Weighted log-likelihood of the chains' document labels, line labels summed out, and its gradients of node and edge weights."""
    scores = x @ node
    evidence = np.log(np.where(label[:, None] == np.arange(2), 1 - NOISE, NOISE))
    free, free_pairs, free_total = forward_backward(scores, edge, mask)
    held, held_pairs, held_total = forward_backward(scores + evidence[:, None, :] * mask[..., None], edge, mask)
    to_node = np.einsum("clf,clk->fk", x, (held - free) * per[:, None, None])
    return float(((held_total - free_total) * per).sum()), to_node, ((held_pairs - free_pairs) * per[:, None, None]).sum(0)


def _padded(chains: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    most = max(len(c) for c in chains)
    out, mask = np.zeros((len(chains), most, chains[0].shape[1])), np.zeros((len(chains), most), dtype=bool)
    for i, c in enumerate(chains):
        out[i, : len(c)], mask[i, : len(c)] = c, True
    return out, mask


class LineField:
    """Weights of the field: node weights (bad, good), edge weights, and the document calibration."""

    def __init__(self) -> None:
        self.node, self.edge, self.slope, self.shift, self.constant = np.zeros((N_FEATURES, 2)), np.zeros((2, 2)), 1.0, 0.0, None

    def marginals(self, chains: list[np.ndarray]) -> list[np.ndarray]:
        """Probability of good for each line of each chain of features."""
        order, out = np.argsort([len(c) for c in chains], kind="stable"), [None] * len(chains)
        at = 0
        while at < len(order):  # chains of about the same length together
            stop, longest = at + 1, len(chains[order[at]])
            while stop < len(order) and len(chains[order[stop]]) <= longest * 1.5 + 2 and stop - at < 2048:
                stop += 1
            block = [chains[i] for i in order[at:stop]]
            x, mask = _padded(block)
            good, _, _ = forward_backward(x @ self.node, self.edge, mask)
            for k, i in enumerate(order[at:stop]):
                out[i] = good[k, : len(chains[i]), 1]
            at = stop
        return out

    def raw(self, texts: list[str | None]) -> np.ndarray:
        """Log-odds of the length-weighted mean marginal of each text."""
        docs = [(t or "").split("\n") for t in texts]
        flat = features_of(docs)
        chains, parts = [], []
        for d, f in enumerate(flat):
            for s in range(0, len(f), CHAIN):
                low, high = max(0, s - CONTEXT), min(len(f), s + CHAIN + CONTEXT)
                chains.append(f[low:high])
                parts.append((d, s - low, min(len(f), s + CHAIN) - low))
        weights = [np.array([len(x) + 1.0 for x in lines]) for lines in docs]
        total, good, used = np.array([w.sum() for w in weights]), np.zeros(len(docs)), np.zeros(len(docs), dtype=np.int64)
        for (d, a, b), m in zip(parts, self.marginals(chains)):
            w = weights[d][used[d] : used[d] + b - a]
            good[d] += (w * m[a:b]).sum()
            used[d] += b - a
        share = np.clip(good / total, 1e-6, 1 - 1e-6)
        return np.log(share / (1 - share))

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return 1 / (1 + np.exp(-(self.slope * self.raw(texts) + self.shift)))


def features_of(docs: list[list[str]]) -> list[np.ndarray]:
    """Features of each document's lines, computed for all lines at once."""
    own = line_features([x for lines in docs for x in lines])
    out, at, gap = [], 0, np.zeros((1, N_LINE))
    for lines in docs:
        f = own[at : at + len(lines)]
        at += len(lines)
        out.append(np.hstack([f, np.vstack([gap, f[:-1]]), np.vstack([f[1:], gap]), np.ones((len(f), 1))]))
    return out


def fit(texts: list[str], labels: np.ndarray) -> LineField:
    """Fits the field on labelled documents, whose line labels are hidden."""
    field, labels = LineField(), np.asarray(labels)
    if len(set(labels.tolist())) < 2:
        field.constant = float(labels.mean()) if len(labels) else 0.5
        return field
    chains, y = [], []
    for f, label in zip(features_of([t.split("\n") for t in texts]), labels):
        for s in range(0, len(f), 64):  # short chains keep the padded arrays small
            chains.append(f[s : s + 64])
            y.append(int(label))
    y = np.array(y)
    share = np.array([(labels == 0).mean(), (labels == 1).mean()])
    order = np.argsort([len(c) for c in chains], kind="stable")
    blocks = []
    for part in np.array_split(order, max(1, len(order) // 512)):
        x, mask = _padded([chains[i] for i in part])
        blocks.append((x, mask, y[part], 0.5 / share[y[part]]))
    velocity = [np.zeros_like(field.node), np.zeros_like(field.edge)]
    square = [np.zeros_like(field.node), np.zeros_like(field.edge)]
    step = 0
    for _ in range(max(1, STEPS // len(blocks)) + 8):
        for x, mask, label, weight in blocks:
            step += 1
            _, node, edge = likelihood(field.node, field.edge, x, mask, label, weight / mask.sum(1) / len(label))
            node, edge = node - DECAY * field.node, edge - EDGE_DECAY * field.edge
            for w, g, v, q in zip((field.node, field.edge), (node, edge), velocity, square):
                v += 0.1 * (g - v)
                q += 0.02 * (g * g - q)
                w += RATE * (v / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.98**step)) + 1e-6)
    raw = field.raw(texts)
    weight = 0.5 / share[labels]
    slope, shift = 1.0, 0.0
    for _ in range(400):  # balanced logistic calibration of the documents' log-odds
        p = 1 / (1 + np.exp(-(slope * raw + shift)))
        gap = (labels - p) * weight
        curve = np.maximum(p * (1 - p) * weight, 1e-9)
        a, b, c = (curve * raw * raw).sum() + 1.0, (curve * raw).sum(), curve.sum() + 1e-3
        g1, g2 = (gap * raw).sum() - slope + 1.0, gap.sum()
        det = a * c - b * b
        slope, shift = slope + 0.5 * (c * g1 - b * g2) / det, shift + 0.5 * (a * g2 - b * g1) / det
    field.slope, field.shift = max(slope, 0.05), shift
    return field


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> tuple[list[str], np.ndarray]:
    """At most about TRAIN_DOCS labelled texts, and TRAIN_CHARS characters of them, outside the evaluation fold."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("id").isNotNull() & ~held_out("id"))
    n = known.count()
    spread = F.pmod(F.xxhash64("id"), F.lit(1 << 20))
    chosen = F.broadcast(known.where(spread < int((1 << 20) * min(1.0, TRAIN_DOCS / max(n, 1)))))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(chosen, "id")
    # Smallest hashes first, as far as the characters go: about as many texts a class as a plain sample of that size has.
    sizes = sorted((r["h"], r["n"]) for r in texts.groupBy(spread.alias("h")).agg(F.sum(F.length("text")).alias("n")).collect())
    last, total = 1 << 20, 0
    for h, size in sizes:
        total += size
        if total > TRAIN_CHARS:
            last = h
            break
    rows = texts.where(spread < last).orderBy("id", "label", "text").collect() if sizes else []
    return [r["text"] for r in rows], np.array([r["label"] for r in rows], dtype=np.int64)


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """id, held_out, score (0 to 1), predicted (1 from THRESHOLD on) per document."""
    field = fit(*training_sample(docs, labels, id_col, text_col, label_col))

    def predict(batches):
        for batch in chunks(batches, 2):
            p = np.round(field.score(batch.column(2).to_pylist()), 6) if batch.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], [id_col, "held_out", "score", "predicted"])

    inner = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), F.col(text_col))
    return inner.mapInArrow(predict, f"`{id_col}` {inner.schema[0].dataType.simpleString()}, held_out boolean, score double, predicted int")


def op8_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
