"""Secret scans: three base rules, and a character convolutional network over every candidate in its context.

The network is trained here, on findings labelled by rule: all values that the base rules find in the documents, and
generated ones from a fixed seed, against candidates that are no secrets. Its probability is calibrated on held-back
findings, a fifth of all, and the threshold has the best F1 of those that keep a stated recall there.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import arrow_batches, staged, trimmed

#: The base rules, as the contract of the query states them.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
KINDS = ("assign", "access", "hex", "network")
LEAST = {"assign": 8, "access": 16, "hex": 32}
#: A candidate of the network: a longest run of these, this long at least.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: What the network sees: characters before, some of the candidate, characters after; longer ones are seen in steps.
BEFORE, INSIDE, AFTER = 20, 40, 4
STEP = INSIDE // 2
WIDTH = BEFORE + INSIDE + AFTER
#: Classes of characters, told apart in the order given; others are the last class but one, and no character is the last.
CLASSES = ("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "+", "/", "_", "-", "=", ".", ":", "@", "'\"", " \t\n\r", ",;!?()[]{}<>#$%&*")
N = len(CLASSES) + 2
FILTERS, SPAN = 16, 5
#: Generated findings; all those of a label in the documents weigh as much as half of them at most, however many they are.
GENERATED = 2_000
#: Steps over all findings, and the parts of a unit to which their answers are rounded where they are counted.
STEPS, LEVELS = 16, 256
#: Recall that the threshold keeps on held-back findings.
RECALL = 0.95
SEED = 17

_CLASS = np.full(256, N - 2, np.int8)
for _i, _chars in enumerate(CLASSES):
    _CLASS[np.frombuffer(_chars.encode(), np.uint8)] = _i
_RUN = np.zeros(256, bool)
_RUN[np.frombuffer((string.ascii_letters + string.digits + "+/_=-").encode(), np.uint8)] = True


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind in the order of KINDS; leftmost matches of each rule that do not overlap."""
    found = []
    for kind, rule in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX)):
        for m in rule.finditer(text):
            if len(m.group(2) if kind == "assign" else m.group()) >= LEAST[kind]:
                found.append((m.start(), m.end(), kind))
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def candidates(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in CANDIDATE.finditer(text)]


def uncovered(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Candidates, and what base spans leave of one, if that is a candidate by itself."""
    found = []
    for start, end in candidates(text):
        for s, e, _ in base:
            if s < end and start < e:
                found.append((start, min(s, end)))
                start = max(start, e)
        found.append((start, end))
    return [(s, e) for s, e in found if CANDIDATE.fullmatch(text, s, e)]


def views(start: int, end: int) -> list[int]:
    """Starts of the windows that together see the whole candidate."""
    return [*range(start, end - INSIDE, STEP), max(start, end - INSIDE)]


def window(text: str, start: int, end: int) -> np.ndarray:
    """The classes of the characters that the network sees; no character where text or candidate end."""
    def codes(part: str, width: int, right: bool) -> np.ndarray:
        raw = np.frombuffer(part.encode("latin-1", "replace"), np.uint8)
        out = np.full(width, N - 1, np.int8)
        if len(raw):
            out[width - len(raw):] = _CLASS[raw] if right else out[width - len(raw):]
            if not right:
                out[: len(raw)] = _CLASS[raw]
        return out

    return np.concatenate([codes(text[max(0, start - BEFORE):start], BEFORE, True), codes(text[start:min(end, start + INSIDE)], INSIDE, False), codes(text[end:end + AFTER], AFTER, False)])


@dataclass
class Network:
    """One convolution over character classes, the largest answer of each filter over the candidate's places, one logistic unit."""

    kernel: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    shift: float
    slope: float = 1.0
    offset: float = 0.0
    threshold: float = 0.5
    #: Of the held-back findings, and of those among them that come from documents (NaN if none does).
    recall: float = 0.0
    precision: float = 0.0
    document_recall: float = float("nan")

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        hot = np.zeros((len(x), WIDTH, N), np.float32)
        np.put_along_axis(hot, x[:, :, None].astype(np.int64), 1.0, 2)
        seen = np.lib.stride_tricks.sliding_window_view(hot, SPAN, 1).transpose(0, 1, 3, 2).reshape(len(x), WIDTH - SPAN + 1, SPAN * N)
        z = seen @ self.kernel + self.bias
        act = np.maximum(z, 0)
        mean, most = act.mean(1), act.max(1)
        return np.concatenate([most, mean], 1) @ self.out + self.shift, seen, act, act.argmax(1)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(0), *[self.forward(x[i:i + 512])[0] for i in range(0, len(x), 512)]])

    def calibrated(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * logit + self.offset, -30, 30)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return self.calibrated(self.logits(x))

    def largest(self, windows: list[list[np.ndarray]]) -> np.ndarray:
        """The largest probability of each list of windows."""
        if not windows:
            return np.zeros(0)
        p = self.probability(np.array([w for own in windows for w in own], np.int8))
        return np.maximum.reduceat(p, np.cumsum([0, *map(len, windows[:-1])]))


def train(x: np.ndarray, y: np.ndarray, epochs: int = 8, rate: float = 0.01, documents: np.ndarray | None = None) -> Network:
    """Adam over small batches; a fifth of the findings calibrates slope and offset and sets the threshold.

    ``documents`` marks the findings that come from documents; recall is told for them apart.
    """
    rng = np.random.default_rng(SEED)
    order = rng.permutation(len(y))
    held, used = order[: len(y) // 5], order[len(y) // 5:]
    net = Network(rng.normal(0, 0.2, (SPAN * N, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.2, 2 * FILTERS).astype(np.float32), 0.0)
    params = [net.kernel, net.bias, net.out, np.zeros(1, np.float32)]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(used), max(1, len(used) // 128)):
            net.shift = float(params[3][0])
            grads = gradients(net, x[at], y[at], np.full(len(at), 1 / len(at)))
            step += 1
            for p, g, m, v in zip(params, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    net.shift = float(params[3][0])
    net = _calibrated(net, net.logits(x[held]), y[held], np.ones(len(held)))
    if documents is not None and (own := documents[held] & (y[held] == 1)).any():
        net.document_recall = float((net.probability(x[held][own]) >= net.threshold).mean())
    return net


def gradients(net: Network, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """Of the weighted sum of log losses, by kernel, bias, out and shift."""
    logit, seen, act, arg = net.forward(x)
    delta = (((1 / (1 + np.exp(-np.clip(logit, -30, 30)))) - y) * weight).astype(np.float32)
    pooled = np.concatenate([act.max(1), act.mean(1)], 1)
    back = np.zeros_like(act)
    np.put_along_axis(back, arg[:, None, :], delta[:, None, None] * net.out[:FILTERS], 1)
    back += delta[:, None, None] * net.out[FILTERS:] / act.shape[1]
    back *= act > 0
    return [np.tensordot(seen, back, ((0, 1), (0, 1))), back.sum((0, 1)), pooled.T @ delta, delta.sum(keepdims=True)]


def _calibrated(net: Network, logit: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Network:
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * logit + b, -30, 30)))
        w = p * (1 - p) * weight
        h = np.array([[(w * logit * logit).sum() + 1e-2, (w * logit).sum()], [(w * logit).sum(), w.sum() + 1e-2]])
        da, db = np.linalg.solve(h, [(weight * (y - p) * logit).sum() - 1e-2 * (a - 1), (weight * (y - p)).sum() - 1e-2 * b])
        a, b = a + np.clip(da, -1, 1), b + np.clip(db, -1, 1)
    net.slope, net.offset = float(max(a, 1e-3)), float(b)
    if (y == 1).any():
        net.threshold, net.recall, net.precision = recall_threshold(net.calibrated(logit), y, weight=weight)
    return net


def recall_threshold(p: np.ndarray, y: np.ndarray, least: float = RECALL, weight: np.ndarray | None = None) -> tuple[float, float, float]:
    """(threshold, recall, precision): of the thresholds that keep the recall the one of the best F1, half way to the next lower answer.

    Unlike the highest threshold with that recall, it lets no finding go where nothing is gained by it.
    """
    order = np.argsort(-p, kind="stable")
    w = np.ones(len(p)) if weight is None else weight[order]
    q, hits, taken = p[order], np.cumsum(w * y[order]), np.cumsum(w)
    last = np.flatnonzero(np.append(q[1:] != q[:-1], True))
    recall, precision = hits[last] / hits[-1], hits[last] / taken[last]
    f1 = np.where(recall >= least, 2 * recall * precision / np.maximum(recall + precision, 1e-12), -1.0)
    k = int(np.flatnonzero(f1 >= f1.max() - 1e-12)[-1])
    below = q[last[k + 1]] if k + 1 < len(last) else 0.0
    return float((q[last[k]] + below) / 2), float(recall[k]), float(precision[k])


def generated(n: int = GENERATED) -> tuple[np.ndarray, np.ndarray]:
    """Labelled findings from a fixed seed: keys of many forms in many contexts, and long strings that are no secrets."""
    rng = np.random.default_rng(SEED)
    alphabets = [string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "_-", "0123456789abcdef", "0123456789ABCDEF", string.ascii_lowercase + string.digits, string.ascii_uppercase + string.digits, string.ascii_letters]
    draw = lambda alphabet, k: "".join(rng.choice(list(alphabet), k))
    pick = lambda items: items[rng.integers(len(items))]
    vowels, others = "aeiou", "bcdfghlmnprst"
    word = lambda: "".join(draw(others, 1) + draw(vowels, 1) for _ in range(rng.integers(1, 5)))
    xs, ys = [], []
    for i in range(n):
        before = pick([" ".join(word() for _ in range(3)) + " ", word() + ": ", word() + ' = "', word() + "='", "Bearer ", "auth=", "private_key: ", "key=", "(", "\n", ""])
        after = pick([" " + word(), '"', "'", "\n", ")", "", ", "])
        if i % 2:
            value = pick(["", "", "sk_live_", "ghp_", "xox-", "AIza"]) + draw(pick(alphabets), int(rng.integers(20, 60)))
            value += pick(["", "", "=", "=="])
        else:
            kind = rng.integers(10)
            value = {
                0: lambda: "-".join(word() for _ in range(rng.integers(3, 7))) + f"-{rng.integers(1, 3000)}",
                1: lambda: "/".join(word() for _ in range(rng.integers(3, 8))) + f"/{rng.integers(1, 99)}",
                2: lambda: draw(string.digits, int(rng.integers(16, 24))),
                3: lambda: "_".join(word() for _ in range(rng.integers(3, 7))) + str(rng.integers(0, 99)),
                4: lambda: f"{rng.integers(1900, 2100)}-{rng.integers(10, 13)}-{rng.integers(10, 29)}_{rng.integers(10, 24)}-{rng.integers(10, 60)}",
                5: lambda: "".join(word() for _ in range(5)) + str(rng.integers(0, 99)),
                6: lambda: "-".join(draw(string.digits, 4) for _ in range(4)),
                7: lambda: "".join(word() for _ in range(rng.integers(3, 7))),
                8: lambda: "".join(word().capitalize() for _ in range(rng.integers(3, 6))),
                9: lambda: pick(["=", "-", "_", "/"]) * int(rng.integers(16, 60)),
            }[int(kind)]()
            while len(value) < 16:
                value += word()
        text = before + value + after
        xs.append(window(text, len(before), len(before) + len(value)))
        ys.append(i % 2)
    return np.array(xs, np.int8), np.array(ys, float)


def _interesting(batch_text: pa.Array) -> np.ndarray:
    """Rows of an Arrow string array that may hold a span or candidate, told from the bytes of the whole batch."""
    array = batch_text.cast(pa.large_string())
    n = len(array)
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset: array.offset + n + 1]
    raw = array.buffers()[2]
    rows = np.zeros(n, bool)
    if raw is None or not offsets[-1] - offsets[0]:
        return rows
    data = np.frombuffer(raw, np.uint8)[offsets[0]: offsets[-1]]
    starts = offsets - offsets[0]
    run = _RUN[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], run, [False])).astype(np.int8)))
    long_runs = edge[::2][(edge[1::2] - edge[::2]) >= 16]
    ends = edge[1::2][(edge[1::2] - edge[::2]) >= 16]
    for a, b in zip(long_runs, ends):  # a run may reach over rows: all of them are looked at
        rows[max(0, np.searchsorted(starts, a, "right") - 1): np.searchsorted(starts, b, "left")] = True
    lower = data.tobytes().lower()
    for word in (*KEYWORDS, b"akia"):
        at = lower.find(word)
        while at >= 0:
            rows[max(0, np.searchsorted(starts, at, "right") - 1)] = True
            at = lower.find(word, at + 1)
    return rows


def _findings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, start, secret, window): the network's candidates in each text, labelled by the base rules."""
    for batch in batches:
        ids, out = batch.column(0).to_pylist(), []
        for row in np.flatnonzero(_interesting(batch.column(1))):
            text = batch.column(1)[int(row)].as_py() or ""
            base = base_spans(text)
            for start, end in candidates(text):
                known = any(s < end and start < e for s, e, _ in base)
                for at in views(start, end):
                    seen = any(s < min(end, at + INSIDE) and at < e for s, e, _ in base)
                    if seen == known:  # where a rule found a secret, windows beside it have no label
                        out.append((ids[row], at, known, window(text, at, end).tobytes()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], schema=pa.schema([("id", pa.int64()), ("start", pa.int64()), ("secret", pa.bool_()), ("window", pa.binary())]))


def _windows(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("window").to_pylist()), np.int8).reshape(-1, WIDTH)


def refined(net: Network, found: DataFrame, x: np.ndarray, y: np.ndarray) -> Network:
    """The network after STEPS steps over all findings (window, secret, n, held): sums of gradients from every task.

    Those held back, a fifth by the hash of the window, calibrate it and set the threshold, each by its count.
    """
    totals = {(r["held"], r["secret"]): r["n"] for r in found.groupBy("held", "secret").agg(F.sum("n").alias("n")).collect()}
    own = {k: min(1.0, len(y) / 2 * (0.2 if k[0] else 0.8) / n) for k, n in totals.items()}
    held, used = np.arange(len(y)) % 10 < 2, np.arange(len(y)) % 10 >= 2

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(sum(p.size for p in (net.kernel, net.bias, net.out)) + 1)
        for batch in batches:
            seen, secret = _windows(batch), np.asarray(batch.column("secret").to_numpy(zero_copy_only=False), float)
            weight = np.array([own[False, bool(k)] for k in secret]) * batch.column("n").to_numpy()
            for i in range(0, len(seen), 256):
                total += np.concatenate([g.ravel() for g in gradients(net, seen[i:i + 256], secret[i:i + 256], weight[i:i + 256])])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["total"])

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            level = np.rint(np.clip(net.logits(_windows(batch)), -64, 64) * LEVELS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(level), batch.column("secret"), batch.column("n")], ["level", "secret", "n"])

    params = [net.kernel, net.bias, net.out, np.array([net.shift], np.float32)]
    cuts, first, second = np.cumsum([p.size for p in params])[:-1], [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    weight = sum(own[k] * n for k, n in totals.items() if not k[0]) + used.sum()
    for step in range(1, STEPS + 1):
        rows = found.where("not held").mapInArrow(trimmed(sums), "total binary").collect()
        flat = np.sum([np.frombuffer(r["total"]) for r in rows], 0) if rows else np.zeros(int(cuts[-1]) + 1)
        flat = flat + np.concatenate([g.ravel() for g in gradients(net, x[used], y[used], np.ones(used.sum()))])
        for p, g, m, v in zip(params, np.split((flat / weight).astype(np.float32), cuts), first, second):
            m += 0.1 * (g.reshape(p.shape) - m)
            v += 0.001 * (g.reshape(p.shape) ** 2 - v)
            p -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        net.shift = float(params[3][0])
    counted = found.where("held").mapInArrow(trimmed(answers), "level long, secret boolean, n long").groupBy("level", "secret").agg(F.sum("n").alias("n")).orderBy("level", "secret").collect()
    logit, label = np.array([r["level"] / LEVELS for r in counted]), np.array([float(r["secret"]) for r in counted])
    n = np.array([r["n"] * own[True, r["secret"]] for r in counted])
    net = _calibrated(net, np.concatenate([net.logits(x[held]), logit]), np.concatenate([y[held], label]), np.concatenate([np.ones(held.sum()), n]))
    if (label == 1).any():
        net.document_recall = float(n[(label == 1) & (net.calibrated(logit) >= net.threshold)].sum() / n[label == 1].sum())
    return net


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Network:
    """Trains on the generated findings, then on these and all findings of the documents.

    Half of the secrets found by rule are shown without what stands before them, so that the network learns their form.
    """
    arrow_batches(docs.sparkSession)
    found = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).mapInArrow(trimmed(_findings), "id long, start long, secret boolean, window binary")
    part = F.pmod(F.xxhash64("window"), F.lit(10))
    bare = F.concat(F.lit(bytes([N - 1]) * BEFORE), F.substring("window", BEFORE + 1, WIDTH - BEFORE))
    shown = F.when(F.col("secret") & (part % 2 == 0) & (part >= 2), F.array("window", bare)).otherwise(F.array("window"))
    found = found.select("secret", (part < 2).alias("held"), F.explode(shown).alias("window"))
    found = staged(found.groupBy("secret", "held", "window").agg(F.count(F.lit(1)).alias("n")), "secret-findings")
    x, y = generated()
    net = train(x, y)
    return refined(net, found, x, y) if found.limit(1).count() else net


def secret_spans(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans: for each row of ``docs`` the array of (start, end, kind, probability), code points, end exclusive.

    Base spans come as they are (probability 1); the network adds candidates, or what base spans leave of them, that
    reach its threshold in one of their windows at least (the largest probability). Spans of one start are in the
    order of KINDS. A null text counts as empty; texts without spans get an empty array, repeated rows equal arrays,
    an empty table an empty result. Texts and candidates of any length are read whole. Other columns are not read.
    """
    arrow_batches(docs.sparkSession)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("probability", pa.float64())]))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans: list[list] = [[] for _ in range(batch.num_rows)]
            windows, owners = [], []
            for row in np.flatnonzero(_interesting(batch.column(1))):
                text = batch.column(1)[int(row)].as_py() or ""
                base = base_spans(text)
                spans[row] = [(s, e, k, 1.0) for s, e, k in base]
                for start, end in uncovered(text, base):
                    windows.append([window(text, at, end) for at in views(start, end)])
                    owners.append((int(row), start, end))
            for (row, start, end), p in zip(owners, network.largest(windows)):
                if p >= network.threshold:
                    spans[row].append((start, end, "network", float(p)))
            for found in spans:
                found.sort(key=lambda x: (x[0], KINDS.index(x[2])))
            rows = [[dict(zip(("start", "end", "kind", "probability"), s)) for s in found] for found in spans]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["doc_id", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text")).mapInArrow(trimmed(scanned), "doc_id long, spans array<struct<start: long, end: long, kind: string, probability: double>>")


def redact(docs: DataFrame, network: Network, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each span of its texts, or run of overlapping spans, replaced by a mark.

    Null texts stay null, empty ones empty, and repeated rows stay repeated; other columns, whatever their names, come along.
    """
    arrow_batches(docs.sparkSession)
    names, schema = docs.columns, docs.schema
    at = names.index(text_col)

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, changed = batch.column(at), {}
            for row in np.flatnonzero(_interesting(column.fill_null(""))):
                text = column[int(row)].as_py() or ""
                base = base_spans(text)
                spans = [(s, e) for s, e, _ in base]
                free = uncovered(text, base)
                p = network.largest([[window(text, at, end) for at in views(start, end)] for start, end in free])
                spans = sorted(spans + [c for c, q in zip(free, p) if q >= network.threshold])
                parts, last = [], 0
                for s, e in spans:
                    if s >= last:
                        parts += [text[last:s], mark]
                    last = max(last, e)
                if spans:
                    changed[int(row)] = "".join([*parts, text[last:]])
            if changed:
                column = pa.array([changed.get(i, v) for i, v in enumerate(column.to_pylist())], batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([column if i == at else batch.column(i) for i in range(batch.num_columns)], schema=batch.schema)

    return docs.mapInArrow(trimmed(cleaned), schema)
