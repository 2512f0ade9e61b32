"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages (runs of ``PASSAGE_WORDS`` words). Each passage
is encoded from its character histogram and word statistics by a learned dense
layer; gated attention weights, learned from document labels alone, form the
weighted passage representation that the classifier scores.

Defined results: null and empty texts are one empty passage; repeated rows get
equal scores; without labels of both classes every score is the prior (0.5
where there is none); other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadsmith.llm.common import labelled_sample, lead_columns, prior, text_slices, with_fields

PASSAGE_WORDS = 40
#: Bytes of text whose characters a worker holds at a time.
PIECE_BYTES = 1 << 20
#: Histogram of the 128 ASCII characters and of the rest, then four word statistics.
N_CHARS, N_FEATURES = 129, 133


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of all passages, and the number of the text each belongs to.
    Texts are handled in runs of about PIECE_BYTES; a longer one is cut between
    passages."""
    rows, bags, run, numbers, size = [], [], [], [], 0

    def flush():
        if run:
            x, bag = _passages(run)
            rows.append(x)
            bags.append(np.array(numbers)[bag])
        run.clear()
        numbers.clear()

    for i, text in enumerate(texts):
        parts = [text]
        if len(text) > PIECE_BYTES:
            words, each = text.split(), PASSAGE_WORDS * 4096
            parts = [b" ".join(words[lo:lo + each]) for lo in range(0, max(len(words), 1), each)]
        for part in parts:
            if size + len(part) > PIECE_BYTES:
                flush()
                size = 0
            run.append(part)
            numbers.append(i)
            size += len(part)
    flush()
    if not rows:
        return np.zeros((0, N_FEATURES), np.float32), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(bags)


def _passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    stops = np.flatnonzero(~space & np.concatenate([space[1:], [True]])) + 1
    text_of = np.searchsorted(ends, starts, side="right")
    n_words = np.bincount(text_of, minlength=len(texts))
    first = np.cumsum(n_words) - n_words
    n_pass = np.maximum(-(-n_words // PASSAGE_WORDS), 1)
    base = np.cumsum(n_pass) - n_pass
    total = int(n_pass.sum())
    out = np.zeros((total, N_FEATURES), np.float32)
    bag = np.repeat(np.arange(len(texts)), n_pass)
    if not len(starts):
        return out, bag
    word_pass = base[text_of] + (np.arange(len(starts)) - first[text_of]) // PASSAGE_WORDS

    lengths = stops - starts
    word = np.repeat(np.arange(len(starts)), lengths)
    at = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    chars = raw[starts[word] + at]
    hist = np.bincount(word_pass[word] * N_CHARS + np.minimum(chars, 128), minlength=total * N_CHARS)
    hist = hist.reshape(total, N_CHARS)
    out[:, :N_CHARS] = np.sqrt(hist / np.maximum(hist.sum(axis=1, keepdims=True), 1))

    power = np.uint64(1099511628211) ** np.arange(64, dtype=np.uint64)
    marks = (chars.astype(np.uint64) + np.uint64(1)) * power[at % 64] * (at // 64 + 1).astype(np.uint64)
    ids = np.add.reduceat(marks, np.cumsum(lengths) - lengths)
    count = np.bincount(word_pass, minlength=total)
    same = np.concatenate([[False], (ids[1:] == ids[:-1]) & (word_pass[1:] == word_pass[:-1])])
    order = np.lexsort((ids, word_pass))
    new = np.concatenate([[True], (ids[order][1:] != ids[order][:-1]) | (word_pass[order][1:] != word_pass[order][:-1])])
    per = np.maximum(count, 1)
    out[:, N_CHARS] = np.bincount(word_pass, same, minlength=total) / per
    out[:, N_CHARS + 1] = np.bincount(word_pass[order], new, minlength=total) / per
    out[:, N_CHARS + 2] = np.log1p(np.bincount(word_pass, lengths, minlength=total) / per)
    out[:, N_CHARS + 3] = np.log1p(count) / np.log1p(PASSAGE_WORDS)
    return out, bag


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    enc: np.ndarray       # encoder: features x hidden
    enc_b: np.ndarray
    att_v: np.ndarray     # gated attention: hidden x gate, twice, and its weights
    att_u: np.ndarray
    att_w: np.ndarray
    out: np.ndarray       # classifier on the weighted representation
    out_b: np.ndarray
    prior: float | None = None

    PARTS = ("enc", "enc_b", "att_v", "att_u", "att_w", "out", "out_b")

    def forward(self, x: np.ndarray, bag: np.ndarray, n: int):
        """x: standardised passages sorted by bag, at least one in every bag."""
        h = np.tanh(x @ self.enc + self.enc_b)
        tv, su = np.tanh(h @ self.att_v), 1 / (1 + np.exp(-(h @ self.att_u)))
        e = (tv * su) @ self.att_w
        starts = np.searchsorted(bag, np.arange(n))
        e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        a = e / np.add.reduceat(e, starts)[bag]
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        logit = z @ self.out + self.out_b[0]
        return h, tv, su, a, z, 1 / (1 + np.exp(-np.clip(logit, -40, 40)))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        if self.prior is not None:
            return np.full(len(texts), self.prior)
        x, bag = passages(texts)
        return self.forward((x - self.mean) / self.scale, bag, len(texts))[-1].astype(np.float64)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1_000, max_train_bytes: int = 65_536, hidden: int = 24,
        gate: int = 12, epochs: int = 30, batch_bags: int = 64, rate: float = 0.005, l2: float = 1e-4,
        seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """Fit on the texts of ``labels(id, label)``. Bounds, both parameters: about
    ``per_class`` rows of each class, and of those the texts of at most
    ``max_train_bytes`` bytes."""
    labelled, n = labelled_sample(docs, labels, per_class, id_col, text_col)
    rng = np.random.default_rng(seed)
    constant = QualityModel(*[np.zeros(0)] * 9, prior=prior(n))
    if not n[0] or not n[1]:
        return constant
    usable = labelled.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= max_train_bytes)

    def encode(batches):
        for batch, texts in text_slices(batches, 2):
            x, bag = passages(texts)
            cuts = np.searchsorted(bag, np.arange(len(texts) + 1)) * N_FEATURES
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.string()), batch.column(1),
                 pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(x.ravel()))],
                names=["id", "label", "x"])

    rows = usable.select("id", "label", "text").mapInArrow(encode, "id string, label long, x array<float>").toArrow()
    rows = rows.sort_by("id").combine_chunks()
    y = rows["label"].to_numpy().astype(np.float32)
    if len(np.unique(y)) < 2:
        return constant
    xs = rows["x"].combine_chunks()
    cuts = xs.offsets.to_numpy() // N_FEATURES
    passages_ = xs.flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES).copy()
    cuts = cuts - cuts[0]
    del rows, xs
    mean, scale = passages_.mean(axis=0), passages_.std(axis=0) + 0.01
    passages_ -= mean
    passages_ /= scale
    bags = [passages_[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    m = [max(int((y == c).sum()), 1) for c in (0, 1)]
    weight = np.where(y == 1, n[1] / m[1], n[0] / m[0]).astype(np.float32)
    weight /= weight.mean()

    def init(*shape):
        return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

    model = QualityModel(mean, scale, init(N_FEATURES, hidden), np.zeros(hidden, np.float32), init(hidden, gate),
                         init(hidden, gate), init(gate), init(hidden), np.zeros(1, np.float32))
    state = {k: [np.zeros_like(getattr(model, k)), np.zeros_like(getattr(model, k))] for k in model.PARTS}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for lo in range(0, len(order), batch_bags):
            pick = order[lo:lo + batch_bags]
            x = np.concatenate([bags[i] for i in pick])
            bag = np.repeat(np.arange(len(pick)), [len(bags[i]) for i in pick])
            step += 1
            for k, g in _gradient(model, x, bag, y[pick], weight[pick]).items():
                p, (a, b) = getattr(model, k), state[k]
                g = g + l2 * p
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= rate * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.999 ** step)) + 1e-8)
    return model


def _gradient(model: QualityModel, x, bag, y, weight) -> dict[str, np.ndarray]:
    n = len(y)
    h, tv, su, a, z, p = model.forward(x, bag, n)
    starts = np.searchsorted(bag, np.arange(n))
    d = weight * (p - y) / n
    dz = d[:, None] * model.out
    da = (dz[bag] * h).sum(axis=1)
    de = a * (da - np.add.reduceat(a * da, starts)[bag])
    dg = de[:, None] * model.att_w
    dv, du = dg * su * (1 - tv ** 2), dg * tv * su * (1 - su)
    dh = a[:, None] * dz[bag] + dv @ model.att_v.T + du @ model.att_u.T
    dpre = dh * (1 - h ** 2)
    return {"enc": x.T @ dpre, "enc_b": dpre.sum(axis=0), "att_v": h.T @ dv, "att_u": h.T @ du,
            "att_w": (tv * su).T @ de, "out": z.T @ d, "out_b": np.array([d.sum()])}


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text",
          threshold: float = 0.7, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(id, carry..., score, predicted)`` of every whole text."""
    lead, kept, text_at = lead_columns(docs, id_col, text_col, carry)
    fields = lead.schema.fields[:kept]

    def run(batches):
        for batch, texts in text_slices(batches, text_at):
            s = model.scores(texts)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(j) for j in range(kept)), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                names=[*(f.name for f in fields), "__score", "__predicted"])

    return lead.mapInArrow(run, with_fields(fields, "__score double, __predicted int"))
