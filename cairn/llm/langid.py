"""Language ID by a bidirectional gated recurrent network over bytes, written in numpy.

The UTF-8 bytes of a text go through two gated recurrent layers, one in each direction; a softmax over both states
labels every position, and a document's probabilities are the mean over all its positions. Texts are cut into stretches
of about ``SPAN`` bytes between characters, each started from the zero state in both directions, so any number of
documents of any length run as one batch and every byte of the whole text counts. Training is backpropagation through
time on stretches of labelled documents: at most ``per_label`` documents of each label, chosen by a hash of their id, and
of each ``draws`` pieces of ``piece`` characters at hashed places anywhere in the whole text; that is the only bounded
sample. There can be at most ``most_labels`` labels, for each is an output of the network.

A prediction reads the text alone. A text that is null or has no letter (Unicode category L) gets ``und`` and score 0.
With no labelled document at all every text is ``und``. Ties go to the label that sorts first.

Defined results: documents with a null label or text teach nothing; repeated rows are predicted alike; very long texts
are read whole, some megabytes of texts at a time; an empty table gives no rows; further columns are kept or ignored as
the function says.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, relieved

#: Bytes in a stretch, and stretches that run side by side.
SPAN, SIDE = 128, 1024
#: The most bytes by which a stretch is longer, to end between characters.
_OVER = 3
_WORDY = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    """Whether a character is of category L; numbers such as superscripts and Roman numerals are not."""
    return any(m[0].isalpha() for m in _WORDY.finditer(text or ""))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


@dataclass
class Model:
    """Labels and weights. in_*: a row for each byte; rec_*: state to gates; index 0 is forward, 1 backward."""

    labels: list[str]
    in_gates: np.ndarray  # 2 x 256 x 2H: update, reset
    in_state: np.ndarray  # 2 x 256 x H
    rec_gates: np.ndarray  # 2 x H x 2H
    rec_state: np.ndarray  # 2 x H x H
    out: np.ndarray  # 2 x H x L
    bias: np.ndarray  # L

    def parts(self) -> list[np.ndarray]:
        return [self.in_gates, self.in_state, self.rec_gates, self.rec_state, self.out, self.bias]


def fresh(labels: list[str], hidden: int, seed: int) -> Model:
    rng = np.random.default_rng(seed)
    draw = lambda *s, by: (rng.standard_normal(s) * by).astype(np.float32)
    h = hidden
    return Model(labels, draw(2, 256, 2 * h, by=0.3), draw(2, 256, h, by=0.3), draw(2, h, 2 * h, by=h**-0.5), draw(2, h, h, by=h**-0.5), draw(2, h, len(labels), by=h**-0.5), np.zeros(len(labels), np.float32))


def gradients(model: Model, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean loss over all positions of x (stretches x bytes) with labels y, and its gradients, through time."""
    n, span = x.shape
    h = model.rec_state.shape[1]
    states, kept = [], []
    for d in (0, 1):
        order = range(span) if d == 0 else range(span - 1, -1, -1)
        s, path = np.zeros((n, h), np.float32), {}
        all_states = np.empty((span, n, h), np.float32)
        for t in order:
            g = _sigmoid(model.in_gates[d][x[:, t]] + s @ model.rec_gates[d])
            z, r = g[:, :h], g[:, h:]
            u = s @ model.rec_state[d]
            c = np.tanh(model.in_state[d][x[:, t]] + r * u)
            path[t] = (s, z, r, u, c)
            s = c + z * (s - c)
            all_states[t] = s
        states.append(all_states)
        kept.append((order, path))
    logits = states[0] @ model.out[0] + states[1] @ model.out[1] + model.bias
    logits -= logits.max(2, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(2, keepdims=True)
    loss = float(-np.log(p[:, np.arange(n), y] + 1e-9).mean())
    p[:, np.arange(n), y] -= 1
    p /= n * span
    grads = [np.zeros_like(w) for w in model.parts()]
    grads[5] += p.sum((0, 1))
    for d in (0, 1):
        order, path = kept[d]
        grads[4][d] = np.einsum("tnh,tnl->hl", states[d], p, optimize=True)
        back = p @ model.out[d].T
        ds = np.zeros((n, h), np.float32)
        for t in reversed(order):
            s, z, r, u, c = path[t]
            ds = ds + back[t]
            dc = ds * (1 - z) * (1 - c * c)
            dz = ds * (s - c) * z * (1 - z)
            dr = dc * u * r * (1 - r)
            dg = np.concatenate((dz, dr), 1)
            du = dc * r
            np.add.at(grads[0][d], x[:, t], dg)
            np.add.at(grads[1][d], x[:, t], dc)
            grads[2][d] += s.T @ dg
            grads[3][d] += s.T @ du
            ds = ds * z + dg @ model.rec_gates[d].T + du @ model.rec_state[d].T
    return loss, grads


def trained(texts: list[str], labels: list[str], hidden: int = 8, steps: int = 500, batch: int = 128, span: int = 48, rate: float = 0.02, seed: int = 7) -> Model:
    """A model of labelled texts; each step takes as many stretches of every label."""
    names = sorted(set(labels))
    model, rng = fresh(names, hidden, seed), np.random.default_rng(seed)
    if len(names) < 2:
        return model
    pieces: dict[str, list[bytes]] = {n: [] for n in names}
    for text, label in zip(texts, labels, strict=True):
        pieces[label].append(text.encode("utf-8", "surrogatepass").ljust(span))
    joined = {n: np.frombuffer(b"".join(x), np.uint8) for n, x in pieces.items()}
    sizes = {n: np.fromiter(map(len, x), np.int64, len(x)) for n, x in pieces.items()}

    def drawn(n: str, count: int) -> np.ndarray:
        """Stretches that lie in one text each, any place of all texts being as likely as another."""
        room = sizes[n] - span + 1
        ends = np.cumsum(room)
        place = rng.integers(0, ends[-1], count)
        which = np.searchsorted(ends, place, "right")
        start = place - (ends - room)[which] + (np.cumsum(sizes[n]) - sizes[n])[which]
        return joined[n][start[:, None] + np.arange(span)]

    first, second = [np.zeros_like(w) for w in model.parts()], [np.zeros_like(w) for w in model.parts()]
    each = max(1, batch // len(names))
    y = np.repeat(np.arange(len(names)), each)
    for step in range(1, steps + 1):
        x = np.concatenate([drawn(n, each) for n in names])
        grads = gradients(model, x, y)[1]
        norm = float(np.sqrt(sum((g * g).sum() for g in grads)))
        now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for w, g, m, v in zip(model.parts(), grads, first, second, strict=True):
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model


class _Room:
    """Buffers for SIDE stretches, used again and again so that they stay in the processor's cache."""

    def __init__(self, hidden: int, labels: int) -> None:
        e = lambda *s: np.empty(s, np.float32)
        self.g, self.g2, self.c, self.u, self.s = e(SIDE, 2 * hidden), e(SIDE, 2 * hidden), e(SIDE, hidden), e(SIDE, hidden), e(SIDE, hidden)
        self.logits = e(SPAN + _OVER, SIDE, labels)


def _pass(model: Model, d: int, x: np.ndarray, active: np.ndarray, room: _Room) -> None:
    """Add one direction's share to the logits. x: bytes, span x stretches; active: how many stretches reach each byte."""
    h = model.rec_state.shape[1]
    # half the gates' input: sigmoid(x) = (1 + tanh(x / 2)) / 2
    in_gates, rec_gates = model.in_gates[d] * np.float32(0.5), model.rec_gates[d] * np.float32(0.5)
    room.s[:] = 0
    for t in range(len(x)) if d == 0 else range(len(x) - 1, -1, -1):
        n = int(active[t])
        s, g, g2, c, u = room.s[:n], room.g[:n], room.g2[:n], room.c[:n], room.u[:n]
        np.take(in_gates, x[t, :n], 0, out=g, mode="clip")
        np.matmul(s, rec_gates, out=g2)
        g += g2
        np.tanh(g, out=g)
        g *= np.float32(0.5)
        g += np.float32(0.5)
        np.matmul(s, model.rec_state[d], out=u)
        u *= g[:, h:]
        np.take(model.in_state[d], x[t, :n], 0, out=c, mode="clip")
        c += u
        np.tanh(c, out=c)
        s -= c
        s *= g[:, :h]
        s += c
        if d == 0:
            np.matmul(s, model.out[d], out=room.logits[t, :n])
        else:
            room.logits[t, :n] += s @ model.out[d]


def probabilities(model: Model, texts: list[str]) -> np.ndarray:
    """The mean over all byte positions of each text; zero for texts without bytes."""
    labels = len(model.labels)
    raw = [np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8) for t in texts]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    pieces = -(-sizes // SPAN)
    owner = np.repeat(np.arange(len(raw)), pieces)
    begin = np.cumsum(sizes) - sizes
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = begin[owner] + nth * SPAN
    flat = np.concatenate([*raw, np.zeros(SPAN + _OVER, np.uint8)])
    for _ in range(_OVER):  # back to the first byte of a character
        start -= flat[start] & 0xC0 == 0x80
    length = np.append(start[1:], sizes.sum()) - start
    by = np.argsort(-length, kind="stable")
    total = np.zeros((len(raw), labels))
    room = _Room(model.rec_state.shape[1], labels)
    for i in range(0, len(by), SIDE):
        some = by[i : i + SIDE]
        lengths = length[some]
        span = int(lengths[0])
        x = np.ascontiguousarray(flat[start[some][:, None] + np.arange(span)].T).astype(np.intp)
        active = len(some) - np.searchsorted(lengths[::-1], np.arange(span), "right")
        for d in (0, 1):
            _pass(model, d, x, active, room)
        p = room.logits[:span, : len(some)]
        p += model.bias
        p -= p.max(2, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(2, keepdims=True)
        p[np.arange(span)[:, None] >= lengths[None, :]] = 0
        np.add.at(total, owner[some], p.sum(0, dtype=np.float64))
    return total / np.maximum(sizes, 1)[:, None]


def predicted(model: Model | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """The label and its pooled probability for each text."""
    out, score = ["und"] * len(texts), [0.0] * len(texts)
    known = [i for i, t in enumerate(texts) if has_letter(t)]
    if not model or not model.labels or not known:
        return out, score
    distinct: dict[str, int] = {}
    place = [distinct.setdefault(texts[i], len(distinct)) for i in known]
    p = probabilities(model, list(distinct))
    for i, at in zip(known, place, strict=True):
        best = int(p[at].argmax())
        out[i], score[i] = model.labels[best], float(min(1.0, p[at][best]))
    return out, score


def fit(docs: DataFrame, use: Column, key: str = "doc_id", text: str = "text", label: str = "lang", per_label: int = 400, draws: int = 32, piece: int = 120, most_labels: int = 4096, **options) -> Model | None:
    """A model of the documents where ``use`` holds: at most per_label documents of each label, draws pieces of each whole text."""
    fit_on = docs.where(use).where(F.col(label).isNotNull()).where(F.length(text) > 0)
    counts = dict(map(tuple, fit_on.groupBy(F.col(label).cast("string")).count().limit(most_labels + 1).collect()))
    if len(counts) > most_labels:
        raise ValueError(f"more than {most_labels} labels")
    if not counts:
        return None
    rank = F.pmod(F.xxhash64(F.col(key).cast("string"), F.col(text)), F.lit(1_000_003))
    bound = F.lit(0)
    for name, n in counts.items():
        bound = F.when(F.col(label).cast("string") == name, F.lit(min(1_000_003, int(3_000_000 * per_label / n) + 1))).otherwise(bound)
    near = fit_on.select(F.col(label).cast("string").alias("y"), F.col(key).cast("string").alias("k"), F.col(text).cast("string").alias("t"), rank.alias("r"), bound.alias("most")).where("r < most")
    place = lambda i: (F.pmod(F.xxhash64("r", "k", i), F.greatest(F.length("t") - piece + 1, F.lit(1))) + 1).cast("int")
    drawn = near.select("y", "r", "k", F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(draws)), lambda i: F.substring(F.col("t"), place(i), F.lit(piece)))).alias("x"))
    rows = drawn.withColumn("n", F.row_number().over(Window.partitionBy("y").orderBy("r", "k", "x"))).where(F.col("n") <= per_label).orderBy("y", "n").select("x", "y").collect()
    return trained([x for r in rows for x in r.x], [r.y for r in rows for _ in r.x], **options)


def predict(docs: DataFrame, model: Model | None, text: str = "text", to: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with the label and its score in the columns ``to``; columns of those names are replaced."""

    @F.pandas_udf("lang_pred string, score double")
    def of(texts: pd.Series) -> pd.DataFrame:
        got, at, size = ([], []), 0, 0
        values = [None if t is None else str(t) for t in texts]
        for i, t in enumerate(values):
            size += len(t or "")
            if size > 1 << 21 or i == len(values) - 1:
                for to, x in zip(got, predicted(model, values[at : i + 1]), strict=True):
                    to.extend(x)
                at, size = i + 1, 0
        del values, texts
        relieved()
        return pd.DataFrame({"lang_pred": got[0], "score": got[1]})

    lean(docs.sparkSession)
    said = "said_" + uuid.uuid4().hex
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in to]
    return docs.withColumn(said, of(F.col(f"`{text}`").cast("string"))).select(*kept, F.col(f"{said}.lang_pred").alias(to[0]), F.col(f"{said}.score").alias(to[1]))
