"""Operator 2, quality classifier: a linear-chain conditional random field over lines.

Every line that is not blank is good or bad. A line's features are binned measures of its own
text and of its neighbours'; the chain adds a weight for each pair of labels in sequence.
Forward-backward gives each line's probability of being good, and their mean, weighted by the lines'
bytes, is the document's quality.

The field is fitted on at most ``SAMPLE`` labelled documents (those of lowest hash of the id; a
document's label is the label of its lines) and scores every document in one pass without a
shuffle. Only the text enters a score. The model is a few hundred numbers; it is fitted in one task, of at most
``SAMPLE_LINES`` lines, and only it comes to the driver. Documents of the sample are taken whole, in the order
of the hash; one whose lines would pass the bound is left out of the sample (never out of the scores).

Cases: a text without a line (null, empty, blank) scores the share of good documents in the
sample; an empty table gives an empty result; without labels of both kinds every score is that
share (0.5 without any); repeated rows score alike. Labels without a document do not count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_arrow, text_or_empty

SAMPLE = 4000
#: Lines of the sample at most, all its documents together (18 bytes of bins a line).
SAMPLE_LINES = 1_000_000
ROUNDS = 120
RATE = 0.1
L2 = 1e-4

#: Upper edges of the bins of each measure.
BINS = {
    "symbols": (0.0, 0.02, 0.05, 0.1, 0.2),  # of #*$%&|<> among bytes
    "capitals": (0.02, 0.05, 0.1, 0.3, 0.7),  # among ASCII letters
    "shouts": (0.0, 0.1, 0.3, 0.7),  # ! a word
    "digits": (0.0, 0.02, 0.05, 0.1, 0.2),  # among bytes
    "echoes": (0.0, 0.02, 0.1, 0.3, 0.6),  # words equal to the one before
    "distinct": (0.2, 0.4, 0.6, 0.8, 0.95),  # distinct words among words
    "length": (1, 2, 4, 8, 16, 32, 64, 128, 256),  # words
    "word_size": (3.0, 4.5, 5.5, 6.5, 8.0, 12.0),  # bytes a word
    "marks": (0.0, 0.01, 0.03, 0.06, 0.1),  # other ASCII punctuation among bytes
}
_SIZES = [len(e) + 1 for e in BINS.values()]
_FIRST = np.r_[0, np.cumsum(_SIZES)[:-1]]
N_FEATURES = int(sum(_SIZES))
# Classes of bytes: 0 other, 1 white space, 2 newline, 3 symbol, 4 capital, 5 small letter, 6 !, 7 digit, 8 mark
_CLASS = np.zeros(256, np.uint8)
for _chars, _k in ((b" \t\x0b\x0c\r", 1), (b"\n", 2), (b"#*$%&|<>", 3), (bytes(range(65, 91)), 4), (bytes(range(97, 123)), 5),
                   (b"!", 6), (b"0123456789", 7), (b"\"'()+,-./:;=?@[\\]^_`{}~", 8)):
    _CLASS[list(_chars)] = _k
_rng = np.random.default_rng(7)
_BYTE = _rng.integers(0, 2**63, 256).astype(np.uint64)
_POWER = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all lines of the texts that are not blank: bin indexes (lines x measures), bytes, and the text's number."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    kind = _CLASS[buf]
    ends = np.flatnonzero(kind == 2)
    lines = len(ends)
    line_of = np.repeat(np.arange(lines), np.diff(np.r_[-1, ends]))
    count = np.bincount(line_of * 9 + kind, minlength=lines * 9).reshape(lines, 9).astype(float)
    text_of = np.searchsorted(np.cumsum(sizes), ends, side="right")
    inside = (kind != 1) & (kind != 2)
    at = np.flatnonzero(inside)
    words = np.zeros(lines)
    echoes, distinct = words.copy(), words.copy()
    if len(at):
        new = np.r_[True, np.diff(at) > 1]
        first = np.flatnonzero(new)
        place = np.arange(len(at)) - np.repeat(first, np.diff(np.r_[first, len(at)]))
        word = np.add.reduceat(_BYTE[buf[at]] * _POWER[np.minimum(place, 63)], first)
        word_line = line_of[at[first]]
        words = np.bincount(word_line, minlength=lines).astype(float)
        same = np.r_[False, (word[1:] == word[:-1]) & (text_of[word_line[1:]] == text_of[word_line[:-1]])]
        echoes = np.bincount(word_line[same], minlength=lines).astype(float)
        order = np.lexsort((word, word_line))
        w, k = word[order], word_line[order]
        distinct = np.bincount(k[np.r_[True, (w[1:] != w[:-1]) | (k[1:] != k[:-1])]], minlength=lines).astype(float)
    held = words > 0
    n, w, c = count[held].sum(1) - count[held, 2], words[held], count[held]
    measures = {
        "symbols": c[:, 3] / n, "capitals": c[:, 4] / (c[:, 4] + c[:, 5] + 1), "shouts": c[:, 6] / w, "digits": c[:, 7] / n,
        "echoes": echoes[held] / w, "distinct": distinct[held] / w, "length": w, "word_size": (n - c[:, 1]) / w, "marks": c[:, 8] / n,
    }
    bins = np.stack([np.searchsorted(np.array(e, float), measures[m]) + f for (m, e), f in zip(BINS.items(), _FIRST, strict=True)], 1)
    return bins.astype(np.int16), n.astype(np.int64), text_of[held]


class LineField:
    """The conditional random field: label 0 bad, 1 good."""

    def __init__(self, own: np.ndarray, before: np.ndarray, after: np.ndarray, chain: np.ndarray, prior: float):
        self.own, self.before, self.after, self.chain, self.prior = own, before, after, chain, prior

    def emissions(self, bins: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Score of each label for each line; ``starts`` marks the first line of a text."""
        out = self.own[bins].sum(1)
        follow = np.flatnonzero(~starts)
        out[follow] += self.before[bins[follow - 1]].sum(1)
        out[follow - 1] += self.after[bins[follow]].sum(1)
        return out

    def marginals(self, score: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of good for each line, and the expected number of each pair of labels in sequence."""
        first = np.flatnonzero(starts)
        size = np.diff(np.r_[first, len(score)])
        order = np.argsort(-size, kind="stable")
        first, size = first[order], size[order]
        active = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), side="right")
        ahead, back = np.zeros_like(score), np.zeros_like(score)
        ahead[first] = score[first]
        t00, t01, t10, t11 = self.chain.ravel()
        for k in range(1, len(active)):
            i = first[: active[k]] + k
            a = ahead[i - 1]
            ahead[i, 0] = score[i, 0] + np.logaddexp(a[:, 0] + t00, a[:, 1] + t10)
            ahead[i, 1] = score[i, 1] + np.logaddexp(a[:, 0] + t01, a[:, 1] + t11)
        for k in range(len(active) - 1, 0, -1):
            i = first[: active[k]] + k
            b = back[i] + score[i]
            back[i - 1, 0] = np.logaddexp(b[:, 0] + t00, b[:, 1] + t01)
            back[i - 1, 1] = np.logaddexp(b[:, 0] + t10, b[:, 1] + t11)
        both = ahead + back
        good = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -700, 700)))
        follow = np.flatnonzero(~starts)
        whole = np.logaddexp(both[follow, 0], both[follow, 1])
        pair = ahead[follow - 1][:, :, None] + self.chain + (score + back)[follow][:, None, :] - whole[:, None, None]
        return good, np.exp(pair).sum(0)

    def quality(self, texts: list[bytes]) -> np.ndarray:
        bins, size, text = line_features(texts)
        out = np.full(len(texts), self.prior)
        if len(text):
            starts = np.r_[True, text[1:] != text[:-1]]
            good, _ = self.marginals(self.emissions(bins, starts), starts)
            total = np.bincount(text, size, len(texts))
            held = total > 0
            out[held] = np.clip(np.bincount(text, size * good, len(texts))[held] / total[held], 0, 1)
        return out


def fit(bins: np.ndarray, starts: np.ndarray, labels: np.ndarray, prior: float, rounds: int = ROUNDS) -> LineField:
    """Maximum likelihood with a small L2 penalty, by Adam on the whole sample. ``labels``: of each line."""
    shapes = [(N_FEATURES, 2)] * 3 + [(2, 2)]
    params, mean, square = ([np.zeros(s) for s in shapes] for _ in range(3))
    follow = np.flatnonzero(~starts)
    truth = np.eye(2)[labels]
    pairs = np.zeros((2, 2))
    np.add.at(pairs, (labels[follow - 1], labels[follow]), 1)
    n = max(1, int(starts.sum()))

    def counts(index: np.ndarray, weight: np.ndarray) -> np.ndarray:
        flat, wide = index.ravel().astype(np.int64), bins.shape[1]
        return np.stack([np.bincount(flat, np.repeat(weight[:, k], wide), N_FEATURES) for k in (0, 1)], 1)

    for step in range(1, rounds + 1):
        field = LineField(*params, prior)
        good, expected = field.marginals(field.emissions(bins, starts), starts)
        miss = truth - np.stack([1 - good, good], 1)
        slopes = [counts(bins, miss), counts(bins[follow - 1], miss[follow]), counts(bins[follow], miss[follow - 1]), pairs - expected]
        for p, g, m, s in zip(params, slopes, mean, square, strict=True):
            g = g / n - L2 * p
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            p += RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return LineField(*params, prior)


def fit_sample(found: list[tuple[int, bytes]], rounds: int = ROUNDS) -> LineField:
    """The field fitted to documents given by label and bins."""
    prior = float(np.mean([q for q, _ in found])) if found else 0.5
    parts = [(np.frombuffer(b, np.int16).reshape(-1, len(BINS)), q) for q, b in found if b]
    if len({q for _, q in parts}) < 2:
        zero = np.zeros((N_FEATURES, 2))
        lean = zero.copy()
        lean[:, 1] = np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)) / len(BINS)
        return LineField(lean, zero, zero, np.zeros((2, 2)), prior)
    bins = np.concatenate([p for p, _ in parts])
    starts = np.zeros(len(bins), bool)
    starts[np.cumsum([0] + [len(p) for p, _ in parts[:-1]])] = True
    return fit(bins, starts, np.repeat([q for _, q in parts], [len(p) for p, _ in parts]), prior, rounds)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, rounds: int = ROUNDS, lines: int = SAMPLE_LINES) -> LineField:
    """Fit on at most ``sample`` documents with a label (doc_id, quality), of at most ``lines`` lines together, in one task."""
    chosen = labels.filter("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", text_or_empty().cast("binary").alias("_raw")).join(F.broadcast(chosen), "doc_id")  # at most ``sample`` rows

    def features(batches):
        for batch in batches:
            for at in range(batch.num_rows):  # a row at a time: texts may be very long
                part = batch.slice(at, 1)
                bins = line_features(part.column("_raw").to_pylist())[0]
                if len(bins) <= lines:
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality"), pa.array([bins.tobytes()], pa.binary()),
                                                      pa.array([len(bins)], pa.int64())], ["doc_id", "quality", "bins", "n"])

    def weights(batches):
        found, room = [], lines
        for batch in batches:
            for i, q, b, n in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "quality", "bins", "n")), strict=True):
                if n <= room:
                    found.append((i, q, b))
                    room -= n
        field = fit_sample([r[1:] for r in sorted(found, key=lambda r: r[0])], rounds)
        arrays = [field.own, field.before, field.after, field.chain, np.array([field.prior])]
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([a.ravel() for a in arrays]).tobytes()], pa.binary())], ["weights"])

    kind = dict(rows.dtypes)["doc_id"]
    found = map_arrow(rows.select("doc_id", "quality", "_raw"), features, f"doc_id {kind}, quality int, bins binary, n long")
    # Of rows that repeat an id the same one is taken in every run: the shortest, by its bins.
    found = found.groupBy("doc_id").agg(F.min(F.struct("n", "bins", "quality")).alias("row")).select("doc_id", "row.quality", "row.bins", "row.n")
    found = found.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id")
    got = map_arrow(found, weights, "weights binary").collect()  # one row
    if not got:  # no document with a label
        return fit_sample([])
    flat, size = np.frombuffer(got[0].weights).copy(), 2 * N_FEATURES
    own, before, after = (flat[k * size : (k + 1) * size].reshape(N_FEATURES, 2) for k in range(3))
    return LineField(own, before, after, flat[3 * size : 3 * size + 4].reshape(2, 2), float(flat[-1]))


def score(docs: DataFrame, field: LineField, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``score`` of every document."""
    from pyspark.sql import types as T

    rows = docs.select(*keep, text_or_empty().cast("binary").alias("_raw"))

    def run(batches):
        for batch in batches:
            out, run_of, size = [], [], 0
            for t in batch.column("_raw").to_pylist():
                if run_of and size + len(t) > 1 << 20:
                    out.append(field.quality(run_of))
                    run_of, size = [], 0
                run_of.append(t)
                size += len(t)
            out.append(field.quality(run_of) if run_of else np.zeros(0))
            yield batch.drop_columns(["_raw"]).append_column("score", pa.array(np.concatenate(out)))

    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("score", T.DoubleType())])
    return map_arrow(rows, run, schema)


def op2_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1  # a null id as empty text
    field = train(docs, labels.filter(~held_out))
    return score(docs, field).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
