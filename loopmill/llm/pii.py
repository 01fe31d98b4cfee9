"""Personal data: patterns with checks, and a character-level bidirectional LSTM with CRF transitions.

The network is trained in numpy on windows of documents whose spans the patterns label, with altered copies
(other separators, signs spelt out) so that it finds forms that the patterns miss. Every kind of span holds a digit, an
at sign or one of the spelt-out signs of CUES, so only text within REACH characters of one is read, in overlapping windows. The windows are decoded
and reconciled over the whole text: each character takes its label from the window in which it lies farthest from an edge, and spans
are read from the joined labels, so a span may be longer than a window. Spans of the patterns always stay; the network only adds
spans beside them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import fit_in_task, make_room, share, table, without

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")
#: Signs spelt out: `at` in brackets, `dot` as a word or in brackets.
CUES = re.compile(r"[\[({<] ?(?:at|dot) ?[\])}>]|(?<!\w)dot(?!\w)", re.IGNORECASE)

WINDOW, STRIDE, REACH = 64, 32, 40
HIDDEN, LABELS = 16, 1 + 2 * len(KINDS)
#: Documented bounds of the training sample: documents, windows; and updates of BATCH windows.
TRAIN_DOCS, TRAIN_WINDOWS, UPDATES, BATCH = 1500, 6000, 600, 64
#: Least mean probability of a span's labels for it to be added.
SURE = 0.7


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(kind, start, end) of the patterns' spans in order, and the matches that fail their check; runs of fewer digits than a
    card has are no such matches."""
    kept, failed = [], []
    at, end = text.find("@"), 0
    while at >= 0:
        if m := DOMAIN.match(text, at):
            start = at
            while start > end and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                end = m.end()
                kept.append((0, start, end))
        at = text.find("@", at + 1)
    for kind, pattern, good in (
        (1, IP, lambda x: all(len(p) < 4 and int(p) < 256 for p in (p.lstrip("0") or "0" for p in x.split(".")))),
        (2, CARD, lambda x: 16 <= len(d := NOT_DIGIT.sub("", x)) <= 19 and luhn(d)),
        (3, PHONE, lambda x: 8 <= len(NOT_DIGIT.sub("", x)) <= 15),
    ):
        for m in pattern.finditer(text):
            if good(m.group()):
                kept.append((kind, *m.span()))
            elif kind != 2 or len(NOT_DIGIT.sub("", m.group())) >= 16:
                failed.append((kind, *m.span()))
    return kept, failed


def char_table() -> np.ndarray:
    out = np.full(0x10000, 98, np.uint8)
    for c in range(0x10000):
        out[c] = c - 31 if 32 <= c < 127 else 96 if chr(c).isspace() else 97 if chr(c).isalpha() else 98
    return out


CHARS = char_table()
SYMBOLS = 99


def classes_of(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return CHARS[np.minimum(points, 0xFFFF)]


def window_starts(x: np.ndarray, text: str) -> np.ndarray:
    """Starts of the windows that cover all text within REACH of a digit, an at sign or a cue; multiples of STRIDE."""
    hot = np.flatnonzero(((x >= 17) & (x <= 26)) | (x == 33))
    cues = [m.start() for m in CUES.finditer(text)]
    if cues:
        hot = np.concatenate([hot, cues])
    if not hot.size:
        return hot
    blocks = np.unique(np.concatenate([(hot + d) // STRIDE for d in (-REACH, -STRIDE // 2, 0, STRIDE // 2, REACH)]))
    blocks = np.unique(np.concatenate([blocks - 1, blocks]))
    return STRIDE * blocks[(blocks >= 0) & (blocks * STRIDE < len(x))]


def sigmoid(z):
    return 1 / (1 + np.exp(-z))


class Network:
    """Embedding-free LSTM in two directions, a linear layer, CRF transitions. Arrays in `p`."""

    def __init__(self, seed: int = 4):
        rng, h = np.random.default_rng(seed), HIDDEN
        self.p = {}
        for d in "fb":
            self.p[f"x{d}"] = rng.normal(0, 0.3, (SYMBOLS, 4 * h)).astype(np.float32)
            self.p[f"h{d}"] = rng.normal(0, 0.5 / h**0.5, (h, 4 * h)).astype(np.float32)
            self.p[f"c{d}"] = np.repeat([0, 1, 0, 0], h).astype(np.float32)
        self.p["o"] = rng.normal(0, 0.3, (2 * h, LABELS)).astype(np.float32)
        self.p["ob"] = np.zeros(LABELS, np.float32)
        self.p["t"] = np.zeros((LABELS, LABELS), np.float32)

    def lstm(self, x: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states (steps, windows, HIDDEN) in text order; what the backward pass needs if keep."""
        n, steps, h = x.shape[0], x.shape[1], HIDDEN
        state = np.zeros((n, h), np.float32)
        cell, out, saved = state, np.empty((steps, n, h), np.float32), []
        wx, wh = self.p[f"x{d}"] + self.p[f"c{d}"], self.p[f"h{d}"]
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = wx[x[:, t]] + state @ wh
            s = sigmoid(z[:, : 3 * h])
            g = np.tanh(z[:, 3 * h :])
            i, f, o = s[:, :h], s[:, h : 2 * h], s[:, 2 * h :]
            new = f * cell + i * g
            squashed = np.tanh(new)
            if keep:
                saved.append((t, state, cell, i, f, o, g, squashed))
            cell, state = new, o * squashed
            out[t] = state
        return out, saved

    def lstm_back(self, x: np.ndarray, d: str, saved: list, dout: np.ndarray, grad: dict) -> None:
        h = HIDDEN
        wh = self.p[f"h{d}"]
        dstate = dcell = np.zeros((x.shape[0], h), np.float32)
        for t, state, cell, i, f, o, g, squashed in reversed(saved):
            dh = dout[t] + dstate
            dc = dcell + dh * o * (1 - squashed * squashed)
            dz = np.concatenate([dc * g * i * (1 - i), dc * cell * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - g * g)], 1)
            np.add.at(grad[f"x{d}"], x[:, t], dz)
            grad[f"h{d}"] += state.T @ dz
            grad[f"c{d}"] += dz.sum(0)
            dstate, dcell = dz @ wh.T, dc * f

    def emissions(self, x: np.ndarray) -> np.ndarray:
        h = np.concatenate([self.lstm(x, "f", False)[0], self.lstm(x, "b", False)[0]], 2)
        return h @ self.p["o"] + self.p["ob"]

    def step(self, x: np.ndarray, y: np.ndarray) -> dict:
        """Gradient of the CRF's negative log-likelihood of labels y, per window."""
        (hf, sf), (hb, sb) = self.lstm(x, "f", True), self.lstm(x, "b", True)
        h = np.concatenate([hf, hb], 2)
        e, tr = h @ self.p["o"] + self.p["ob"], self.p["t"]
        steps, n, _ = e.shape
        ahead = np.empty_like(e)
        ahead[0] = e[0]
        for t in range(1, steps):
            z = ahead[t - 1][:, :, None] + tr
            m = z.max(1)
            ahead[t] = np.log(np.exp(z - m[:, None]).sum(1)) + m + e[t]
        back = np.zeros_like(e)
        for t in range(steps - 2, -1, -1):
            z = tr + (back[t + 1] + e[t + 1])[:, None]
            m = z.max(2)
            back[t] = np.log(np.exp(z - m[:, :, None]).sum(2)) + m
        total = ahead[-1].max(1)
        total = np.log(np.exp(ahead[-1] - total[:, None]).sum(1)) + total
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        de = np.exp(ahead + back - total[None, :, None])
        de[np.arange(steps)[:, None], np.arange(n), y.T] -= 1
        for t in range(1, steps):
            pair = np.exp(ahead[t - 1][:, :, None] + tr + (e[t] + back[t])[:, None] - total[:, None, None])
            grad["t"] += pair.sum(0)
        np.add.at(grad["t"], (y[:, :-1].ravel(), y[:, 1:].ravel()), -1)
        grad["o"], grad["ob"] = np.einsum("tnh,tnl->hl", h, de, optimize=True), de.sum((0, 1))
        dh = de @ self.p["o"].T
        self.lstm_back(x, "f", sf, dh[:, :, :HIDDEN], grad)
        self.lstm_back(x, "b", sb, dh[:, :, HIDDEN:], grad)
        return {k: v / n for k, v in grad.items()}

    def train(self, x: np.ndarray, y: np.ndarray, updates: int = UPDATES, seed: int = 6) -> None:
        """Adam over random batches; then transitions that no label sequence can hold are closed."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(a) for k, a in self.p.items()}
        for u in range(1, updates + 1):
            at = rng.integers(len(x), size=BATCH)
            grad = self.step(x[at], y[at])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            rate = 0.03 * min(1.0, 3 * (1 - u / (updates + 1)))
            for k, g in grad.items():
                g = g * min(1.0, 20 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.p[k] -= (rate * (m[k] / (1 - 0.9**u)) / (np.sqrt(v[k] / (1 - 0.99**u)) + 1e-8)).astype(np.float32)
        for k in range(len(KINDS)):  # inside a kind only after its own labels
            for label in range(LABELS):
                if label not in (1 + 2 * k, 2 + 2 * k):
                    self.p["t"][label, 2 + 2 * k] = -1e4

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best labels by window, and the probability the linear layer gives each of them alone."""
        e = self.emissions(x)
        steps, n, _ = e.shape
        best, came = e[0], np.empty((steps, n, LABELS), np.int8)
        for t in range(1, steps):
            z = best[:, :, None] + self.p["t"]
            came[t] = z.argmax(1)
            best = z.max(1) + e[t]
        y = np.empty((n, steps), np.int8)
        y[:, -1] = best.argmax(1)
        rows = np.arange(n)
        for t in range(steps - 1, 0, -1):
            y[:, t - 1] = came[t][rows, y[:, t]]
        w = np.exp(e - e.max(2, keepdims=True))
        return y, (np.take_along_axis(w, y.T[:, :, None].astype(np.int64), 2)[:, :, 0] / w.sum(2)).T


def altered(text: str, spans: list, rng: np.random.Generator) -> tuple[str, list]:
    """A copy whose spans have another form; the spans move along."""
    out, at, moved = "", 0, []
    for kind, a, b in sorted(spans, key=lambda s: s[1]):
        if a < at:
            continue
        piece = text[a:b]
        digits = NOT_DIGIT.sub("", piece)
        if kind == 0:
            name, domain = piece.split("@", 1)
            at_sign, dot = ((" (at) ", " (dot) "), (" at ", " dot "), (" [at] ", "."), ("(at)", "(dot)"), (" @ ", "."), ("[at]", "[dot]"))[rng.integers(6)]
            piece = name + at_sign + domain.replace(".", dot)
        elif kind == 1:
            piece = piece.replace(".", ("[.]", " . ", "-", "(dot)", " dot ")[rng.integers(5)])
        elif kind == 3:
            piece = (f"({digits[-10:-7]}) {digits[-7:-4]}-{digits[-4:]}", f"{digits[-10:-7]}-{digits[-7:-4]}-{digits[-4:]}", f"00{digits}")[rng.integers(3)]
        elif kind == 2:
            piece = ".".join(digits[i : i + 4] for i in range(0, len(digits), 4))
        out += text[at:a]
        moved.append((kind, len(out), len(out) + len(piece)))
        out += piece
        at = b
    return out + text[at:], moved


def windows(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    padded = np.concatenate((x, np.zeros(WINDOW, np.uint8)))
    return padded[starts[:, None] + np.arange(WINDOW)]


def train(texts: Iterable[str], updates: int = UPDATES) -> Network | None:
    """From whole texts with pattern labels; each text with spans also appears altered twice."""
    rng = np.random.default_rng(8)
    xs, ys, filled = [], [], []
    for text in texts:
        spans, _ = base_spans(text)
        for copy, own in [(text, spans)] + [altered(text, spans, rng) for _ in range(2 if spans else 0)]:
            x = classes_of(copy)
            starts = window_starts(x, copy)
            if not starts.size:
                continue
            y = np.zeros(len(x) + WINDOW, np.int8)
            for kind, a, b in own:
                y[a:b] = 2 + 2 * kind
                y[a] = 1 + 2 * kind
            starts = np.maximum(0, starts + rng.integers(-8, 9, len(starts)))
            starts = starts[starts < len(x)]
            part = y[starts[:, None] + np.arange(WINDOW)]
            xs.append(windows(x, starts))
            ys.append(part)
            filled.append(part.any(1))
    if not xs:
        return None
    x, y, filled = np.vstack(xs), np.vstack(ys), np.concatenate(filled)
    yes, no = rng.permutation(np.flatnonzero(filled)), rng.permutation(np.flatnonzero(~filled))
    at = np.concatenate([yes[: TRAIN_WINDOWS * 2 // 3], no[: TRAIN_WINDOWS // 3]])
    net = Network()
    if len(yes):
        net.train(x[at], y[at].astype(np.int64), updates)
    return net if len(yes) else None


def plausible(kind: int, piece: str) -> bool:
    """Whether a span found by the network can be of its kind at all."""
    digits = NOT_DIGIT.sub("", piece)
    if kind == 0:
        return bool(re.search(r"[^\W_].*(?:@|(?<!\w)at(?!\w)).*[^\W_].*(?:\.|(?<!\w)dot(?!\w)).*[^\W_]", piece, re.IGNORECASE))
    if kind == 1:
        return len(parts := NOT_DIGIT.split(piece)) == 4 and all(p and len(p) < 4 and int(p) < 256 for p in parts)
    if kind == 2:
        return 16 <= len(digits) <= 19 and luhn(digits)
    return 8 <= len(digits) <= 15 and not re.search(r"[A-Za-z@]", piece) and len(piece) > len(digits)


def reconciled(n: int, starts: np.ndarray, labels: np.ndarray, sure: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labels and their probabilities for all n characters of a text: of two windows over a character the one decides in
    which it lies farther from the edge. Unread characters have label 0."""
    label, p = np.zeros(n + WINDOW, np.int8), np.zeros(n + WINDOW, np.float32)
    edge = (WINDOW - STRIDE) // 2
    for a, b in ((0, WINDOW), (edge, edge + STRIDE)):  # whole windows, then over them the middles
        at = starts[:, None] + np.arange(a, b)
        label[at], p[at] = labels[:, a:b], sure[:, a:b]
    return label[:n], p[:n]


def added_spans(text: str, label: np.ndarray, p: np.ndarray, kept: list, failed: Iterable = ()) -> list[tuple[int, int, int]]:
    """Spans of a text's reconciled labels that meet none of `kept` and none of `failed` of their own kind."""
    kind = (label + 1) // 2
    first = np.flatnonzero((kind > 0) & ((label % 2 == 1) | (kind != np.concatenate(([0], kind[:-1])))))
    out = []
    bounds = [*first.tolist(), len(label)]
    for a, end in zip(bounds[:-1], bounds[1:], strict=True):
        stop = np.flatnonzero(kind[a:end] != kind[a])
        b = a + int(stop[0]) if stop.size else end
        if p[a:b].mean() >= SURE and plausible(int(kind[a]) - 1, text[a:b]):
            out.append((int(kind[a]) - 1, a, b))
    return [s for s in out if all(s[2] <= a or b <= s[1] for k, a, b in [*kept, *(f for f in failed if f[0] == s[0])])]


def spans_of(texts: list[str], net: Network | None) -> Iterator[tuple[list, list]]:
    """Per text the patterns' spans and all spans, in order of kind and start."""
    base, held = [base_spans(t) for t in texts], []
    for i, t in enumerate(texts):
        x = classes_of(t)
        starts = window_starts(x, t) if net else np.zeros(0, int)
        if starts.size:
            held.append((i, starts, windows(x, starts)))
    added: dict[int, list] = {}
    if held:
        x = np.vstack([h[2] for h in held])
        parts = [net.decode(x[k : k + 2048]) for k in range(0, len(x), 2048)]
        labels, sure = np.vstack([p[0] for p in parts]), np.vstack([p[1] for p in parts])
        at = 0
        for i, starts, _ in held:
            rows = slice(at, at + len(starts))
            at += len(starts)
            kept, failed = base[i]
            if labels[rows].any():
                added[i] = added_spans(texts[i], *reconciled(len(texts[i]), starts, labels[rows], sure[rows]), kept, failed)
    for i, (kept, _) in enumerate(base):
        yield sorted(kept), sorted(kept + added.get(i, []))


def fit(docs: DataFrame) -> Network | None:
    """On the TRAIN_DOCS texts with a digit or an at sign whose hash is least, each once and whole; in one task. Nulls and
    repeats teach nothing, of texts with equal hashes the least is taken; None without a span to learn from."""
    rows = docs.where(F.col("text").rlike("[0-9@]")).select("text", F.xxhash64("text").alias("_h"))
    some = rows.select("_h").distinct().orderBy("_h").limit(TRAIN_DOCS)
    chosen = rows.join(F.broadcast(some), "_h").groupBy("_h").agg(F.min("text").alias("text"))
    return fit_in_task(chosen.repartition(1).sortWithinPartitions("_h"), lambda found: train(r["text"] for r in found), Network)


def joined(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


SCHEMA = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long, masked string"


def detect(docs: DataFrame, net: Network | None, keep: list[str], mask: bool = True) -> DataFrame:
    """Columns `keep`, numbers and digest of the patterns' spans, all spans and their number, and the text with each span
    replaced by its kind in brackets (overlapping spans by the one that starts first; null without `mask`).

    Null text is empty (and stays null when masked). Rows are handled alone: repeated rows get equal results, an empty table
    gives no rows; texts of any length are read whole. Kept columns with a result's name give way.
    """
    rows = docs.select(*without(keep, SCHEMA), F.col("text").alias("_text"))
    out = StructType(rows.drop("_text").schema.fields + StructType.fromDDL(SCHEMA).fields)
    shared = share(docs.sparkSession, net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        net = shared()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(part.num_columns - 1).to_pylist()
                n, digest, every, total, masked = [[] for _ in KINDS], [], [], [], []
                for text, (base, spans) in zip(texts, spans_of([t or "" for t in texts], net), strict=True):
                    for k in range(len(KINDS)):
                        n[k].append(sum(s[0] == k for s in base))
                    digest.append(hashlib.sha256(joined(base).encode()).hexdigest())
                    every.append(joined(spans))
                    total.append(len(spans))
                    masked.append(masked_text(text, spans) if mask and text else text if mask else None)
                columns = [part.column(i) for i in range(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(c, pa.int64()) for c in n), pa.array(digest, pa.string()), pa.array(every, pa.string()), pa.array(total, pa.int64()), pa.array(masked, pa.string())], names=out.names)

    return rows.mapInArrow(run, out)


def masked_text(text: str, spans: list) -> str:
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{KINDS[kind]}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return detect(docs, fit(docs), ["doc_id"], mask=False).drop("masked")
