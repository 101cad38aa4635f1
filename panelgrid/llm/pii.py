"""Personal data: base patterns, and a character-level bidirectional LSTM with CRF transitions that adds spans.

Base spans (email, ip, card, phone) come from fixed patterns, leftmost and without overlaps per kind; a match that fails
its check is dropped. The network is trained with numpy from labelled spans: base spans of a bounded sample of regions, some
of them also in other usual forms (a phone number without its country code, a card number in groups). It tags characters
with the begin and the inside of each kind.

A span holds a digit or an @, so only regions around such characters are read by the network: `PAD` characters on each
side of each, joined where they meet; all of them, whatever the length of the text. A region is cut into overlapping
windows; the scores of a character in the windows that hold it are blended, those far from a window's edge weighing
more, and one best path over the region settles all windows together. A span of the path is added if its mean
posterior is at least `TRUST` (for a card `TRUST_CARD` and a right check digit) and no base span overlaps it. Base spans always stay.

Defined cases: a null text counts as empty and has no spans; texts of any length are read whole; patterns cost time in
proportion to the text; repeated rows are treated alike; without any labelled span no span is added; other columns are
not read (`redact` passes them through).
"""

from __future__ import annotations

import hashlib
import random
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelgrid.llm.langtags import forward_backward, time_major

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE, PAD = 48, 24, 24
TRUST = 0.9
FIT_SHARES = 16
TRUST_CARD = 0.4  # of spans that pass the check digit
ANCHOR = re.compile(r"[0-9@]")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ is tried once: the whole run of local characters before it, and the domain after it."""
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and LOCAL.match(text[start - 1]):
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
        free = domain.end() if domain else at + 1
        at = text.find("@", free)


def luhn(digits: str) -> bool:
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (doubled + sum(int(d) for d in digits[::-2])) % 10 == 0


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, by kind and start."""
    if not text:
        return []
    spans = [(0, a, b) for a, b in _emails(text)]
    spans += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            spans.append((2, m.start(), m.end()))
    if "+" in text:
        spans += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return spans


def regions(text: str | None) -> list[tuple[int, int]]:
    """The parts of a text around its digits and @ signs."""
    out: list[tuple[int, int]] = []
    for m in ANCHOR.finditer(text or ""):
        low, high = max(0, m.start() - PAD), min(len(text), m.end() + PAD)
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], high)
        else:
            out.append((low, high))
    return out


SYMBOLS = 101


def symbols(text: str) -> np.ndarray:
    """Code points as symbols of the network: ASCII as itself with one symbol for all digits, the rest by class."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    out = np.where((codes >= 32) & (codes < 127), codes - 30, 98)
    out[(codes >= 48) & (codes < 58)] = 48 - 30
    out[codes == 10] = 97
    out[(codes < 32) & (codes != 10)] = 99
    out[codes >= 0x250] = 100
    return out


def windows(size: int) -> np.ndarray:
    """Starts of the windows of a region; the last one ends with it."""
    if size <= WINDOW:
        return np.zeros(1, np.int64)
    return np.unique(np.append(np.arange(0, size - WINDOW, STRIDE), size - WINDOW))


class Network:
    """Embedding, one LSTM for each direction, linear scores, and transitions between tags."""

    def __init__(self, width: int = 12, hidden: int = 20, seed: int = 11):
        rng = np.random.default_rng(seed)
        tags = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
        near = lambda *shape: (rng.normal(size=shape) * np.sqrt(1.0 / shape[0])).astype(np.float32)
        self.hidden, self.trained = hidden, False
        self.p = {"embed": near(SYMBOLS, width) * 4, "out": near(2 * hidden, tags), "bias": np.zeros(tags, np.float32), "start": np.zeros(tags, np.float32), "step": np.zeros((tags, tags), np.float32)}
        for side in "fb":
            self.p |= {f"{side}x": near(width, 4 * hidden), f"{side}h": near(hidden, 4 * hidden), f"{side}b": np.zeros(4 * hidden, np.float32)}
            self.p[f"{side}b"][hidden : 2 * hidden] = 1.0
        self.never_start = np.zeros(tags, bool)
        self.never_step = np.zeros((tags, tags), bool)
        for k in range(len(KINDS)):
            inside = 2 + 2 * k
            self.never_start[inside] = True
            self.never_step[:, inside] = True
            self.never_step[[inside - 1, inside], inside] = False

    @property
    def start(self) -> np.ndarray:
        return np.where(self.never_start, -1e4, self.p["start"]).astype(np.float64)

    @property
    def step(self) -> np.ndarray:
        return np.where(self.never_step, -1e4, self.p["step"]).astype(np.float64)

    def _direction(self, side: str, x: np.ndarray, trace: list | None) -> np.ndarray:
        """Hidden states over time (time x rows x hidden); `trace` gets what the gradient needs."""
        n = self.hidden
        half = np.full(4 * n, 0.5, np.float32)
        half[3 * n :] = 1.0
        wh = self.p[f"{side}h"] * half
        z_in = x @ (self.p[f"{side}x"] * half) + self.p[f"{side}b"] * half
        h = np.zeros((x.shape[1], n), np.float32)
        c = np.zeros_like(h)
        out = np.empty((x.shape[0], x.shape[1], n), np.float32)
        for t in range(x.shape[0]) if side == "f" else range(x.shape[0] - 1, -1, -1):
            gates = np.tanh(z_in[t] + h @ wh)
            gates[:, : 3 * n] *= 0.5
            gates[:, : 3 * n] += 0.5
            before, h_before = c, h
            c = gates[:, n : 2 * n] * c + gates[:, :n] * gates[:, 3 * n :]
            squashed = np.tanh(c)
            h = gates[:, 2 * n : 3 * n] * squashed
            out[t] = h
            if trace is not None:
                trace.append((t, gates, before, squashed, h_before))
        return out

    def scores(self, x: np.ndarray, traces: dict | None = None) -> np.ndarray:
        """Tag scores, rows x time x tags, of windows of symbols (rows x time)."""
        embedded = self.p["embed"][x.T]
        sides = []
        for side in "fb":
            trace = None if traces is None else traces.setdefault(side, [])
            sides.append(self._direction(side, embedded, trace))
        hidden = np.concatenate(sides, 2)
        if traces is not None:
            traces["embedded"], traces["hidden"] = embedded, hidden
        return (hidden @ self.p["out"] + self.p["bias"]).transpose(1, 0, 2)

    def gradient(self, x: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss of a batch of windows and its slope for every parameter."""
        traces: dict = {}
        scores = self.scores(x, traces).astype(np.float64)
        rows, steps, kinds = scores.shape
        lengths = np.full(rows, steps)
        posterior, expected, starts = forward_backward(scores.reshape(-1, kinds), lengths, self.start, self.step)
        posterior = posterior.reshape(rows, steps, kinds)
        hit = np.take_along_axis(posterior, tags[:, :, None], 2)
        miss = posterior.copy()
        np.put_along_axis(miss, tags[:, :, None], hit - 1, 2)
        seen = np.zeros((kinds, kinds))
        np.add.at(seen, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), 1)
        n = self.hidden
        slope = {"start": (starts - np.bincount(tags[:, 0], minlength=kinds)) / rows, "step": (expected - seen) / rows}
        d_out = (miss / rows).transpose(1, 0, 2).astype(np.float32)
        slope["out"] = traces["hidden"].reshape(-1, 2 * n).T @ d_out.reshape(-1, kinds)
        slope["bias"] = d_out.sum((0, 1))
        d_hidden = d_out @ self.p["out"].T
        d_embedded = np.zeros_like(traces["embedded"])
        for k, side in enumerate("fb"):
            wx, wh = self.p[f"{side}x"], self.p[f"{side}h"]
            d_wx, d_wh, d_b = np.zeros_like(wx), np.zeros_like(wh), np.zeros(4 * n, np.float32)
            d_h, d_c = np.zeros((rows, n), np.float32), np.zeros((rows, n), np.float32)
            for t, gates, before, squashed, h_before in reversed(traces[side]):
                i, f, o, g = (gates[:, j * n : (j + 1) * n] for j in range(4))
                d_h = d_h + d_hidden[t][:, k * n : (k + 1) * n]
                d_c = d_c + d_h * o * (1 - squashed * squashed)
                d_z = np.concatenate([d_c * g * i * (1 - i), d_c * before * f * (1 - f), d_h * squashed * o * (1 - o), d_c * i * (1 - g * g)], 1)
                d_wx += traces["embedded"][t].T @ d_z
                d_wh += h_before.T @ d_z
                d_b += d_z.sum(0)
                d_embedded[t] += d_z @ wx.T
                d_h, d_c = d_z @ wh.T, d_c * f
            slope |= {f"{side}x": d_wx, f"{side}h": d_wh, f"{side}b": d_b}
        d_embed = np.zeros_like(self.p["embed"])
        np.add.at(d_embed, x.T.ravel(), d_embedded.reshape(-1, d_embedded.shape[2]))
        slope["embed"] = d_embed
        return float(-np.log(np.maximum(hit, 1e-30)).mean()), slope


def other_forms(text: str, spans: list[tuple[int, int, int]], rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """The same text with its phone and card numbers in another usual form."""
    out, at, moved = [], 0, []
    for kind, start, end in sorted(spans, key=lambda s: s[1]):
        if start < at:
            continue
        out.append(text[at:start])
        span = text[start:end]
        if kind == 3 and "(" in span:
            span = span[span.index("(") :]
            if rng.random() < 0.5:
                span = span.replace("(", "").replace(") ", "-")
        elif kind == 2 and span.isdigit() and len(span) == 16:
            span = rng.choice(" -").join(span[i : i + 4] for i in range(0, 16, 4))
        low = sum(map(len, out))
        out.append(span)
        moved.append((kind, low, low + len(span)))
        at = end
    return "".join(out) + text[at:], moved


def train(labelled: list[tuple[str, list[tuple[int, int, int]]]], steps: int = 220, batch: int = 64, rate: float = 0.02, seed: int = 11) -> Network:
    """A network from regions and their spans, by adaptive moments over random batches of windows."""
    net, rng = Network(seed=seed), random.Random(seed)
    xs, ys = [], []
    for text, spans in labelled:
        forms = [(text, spans)]
        if any(kind >= 2 for kind, _, _ in spans) and rng.random() < 0.4:
            forms.append(other_forms(text, spans, rng))
        for form, marks in forms:
            x, y = symbols(form), np.zeros(len(form), np.int64)
            for kind, start, end in marks:
                y[start:end] = 2 + 2 * kind
                y[start] = 1 + 2 * kind
            if len(x) < WINDOW:
                x, y = np.pad(x, (0, WINDOW - len(x)), constant_values=97), np.pad(y, (0, WINDOW - len(y)))
            for at in windows(len(x)):
                piece = y[at : at + WINDOW].copy()
                cut = 0
                while cut < WINDOW and piece[cut] and piece[cut] % 2 == 0:  # the window starts inside a span
                    cut += 1
                if cut:
                    piece[0] -= 1
                xs.append(x[at : at + WINDOW])
                ys.append(piece)
    if not any(y.any() for y in ys):
        return net
    x, y = np.stack(xs), np.stack(ys)
    draw = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    for i in range(1, steps + 1):
        pick = draw.integers(0, len(x), batch)
        _, slope = net.gradient(x[pick], y[pick])
        now = rate * min(1.0, 2.0 * (1 - i / (steps + 1)))
        for k, g in slope.items():
            g = np.clip(g, -1, 1).astype(np.float32)
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            net.p[k] = net.p[k] - now * (first[k] / (1 - 0.9**i)) / (np.sqrt(second[k] / (1 - 0.99**i)) + 1e-6)
    net.trained = True
    return net


def best_paths(scores: np.ndarray, lengths: np.ndarray, start: np.ndarray, step: np.ndarray) -> np.ndarray:
    """The best tag of every character along the best path of its region."""
    running, first, row = time_major(lengths)
    local = np.empty_like(scores)
    local[row] = scores
    back = np.zeros(local.shape, np.uint8)
    total = np.empty_like(local)
    for t, n in enumerate(running):
        here = slice(first[t], first[t] + n)
        if t == 0:
            total[here] = start + local[here]
        else:
            ways = total[first[t - 1] : first[t - 1] + n, :, None] + step
            back[here] = ways.argmax(1)
            total[here] = ways.max(1) + local[here]
    tags = np.zeros(len(local), np.int64)
    for t in range(len(running) - 1, -1, -1):
        n, more = running[t], running[t + 1] if t + 1 < len(running) else 0
        tags[first[t] + more : first[t] + n] = total[first[t] + more : first[t] + n].argmax(1)
        if t + 1 < len(running):
            after = np.arange(first[t + 1], first[t + 1] + more)
            tags[first[t] : first[t] + more] = back[after, tags[after]]
    return tags[row]


def network_spans(net: Network, texts: list[str]) -> list[list[tuple[int, int, int, float]]]:
    """Spans (kind, start, end, trust) of whole regions of any length."""
    found: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
    if not texts or not net.trained:
        return found
    lengths = np.array([len(t) for t in texts], np.int64)
    flat = np.concatenate([symbols(t) for t in texts])
    begins = np.cumsum(lengths) - lengths
    starts, owner = [], []
    for i, size in enumerate(lengths):
        at = windows(int(size))
        starts.append(begins[i] + at)
        owner += [i] * len(at)
    start, owner = np.concatenate(starts), np.array(owner)
    place = start[:, None] + np.arange(WINDOW)
    inside = place < (begins + lengths)[owner][:, None]
    x = np.where(inside, flat[np.minimum(place, len(flat) - 1)], 97)
    weight = (1.0 + np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1]))[None, :].repeat(len(x), 0)
    tags = net.p["bias"].size
    total, mass = np.zeros((len(flat), tags)), np.zeros(len(flat))
    for a in range(0, len(x), 2048):
        rows = slice(a, a + 2048)
        scored = net.scores(x[rows])
        use = inside[rows]
        np.add.at(total, place[rows][use], scored[use] * weight[rows][use][:, None])
        np.add.at(mass, place[rows][use], weight[rows][use])
    scores = total / mass[:, None]
    path = best_paths(scores, lengths, net.start, net.step)
    posterior, _, _ = forward_backward(scores, lengths, net.start, net.step)
    trust = np.concatenate([[0], np.cumsum(np.take_along_axis(posterior, path[:, None], 1)[:, 0])])
    region = np.repeat(np.arange(len(texts)), lengths)
    for p in np.flatnonzero(path % 2 == 1):
        end, limit = p + 1, begins[region[p]] + lengths[region[p]]
        while end < limit and path[end] == path[p] + 1:
            end += 1
        low = begins[region[p]]
        if ANCHOR.search(texts[region[p]], p - low, end - low):
            found[region[p]].append((int(path[p] - 1) // 2, int(p - low), int(end - low), float((trust[end] - trust[p]) / (end - p))))
    return found


def accepted(kind: int, span: str, trust: float) -> bool:
    """Whether a span of the network is added. Numbers with a wrong check digit look like cards, so cards are verified."""
    if KINDS[kind] != "card":
        return trust >= TRUST
    digits = re.sub("[^0-9]", "", span)
    return trust >= TRUST_CARD and 13 <= len(digits) <= 19 and luhn(digits)


def find_spans(net: Network, texts: list[str | None]) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """Base spans and all spans of each text, by kind and start."""
    base = [base_spans(t) for t in texts]
    parts = [(i, low, high) for i, t in enumerate(texts) for low, high in regions(t)]
    every = [list(b) for b in base]
    for (i, low, _), spans in zip(parts, network_spans(net, [texts[i][low:high] for i, low, high in parts])):
        for kind, start, end, trust in spans:
            if accepted(kind, texts[i][low + start : low + end], trust) and all(end + low <= b or start + low >= e for _, b, e in base[i]):
                every[i].append((kind, low + start, low + end))
    return [(b, sorted(e)) for b, e in zip(base, every)]


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def labelled_regions(docs: DataFrame, text: str = "text", fit_regions: int = 1500, fit_chars: int = 400) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """A bounded sample of regions with their base spans, the first by hash of each of `FIT_SHARES` shares; regions over
    `fit_chars` are not learned from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(0).to_pylist():
                spans = base_spans(t)
                for low, high in regions(t):
                    if high - low <= fit_chars:
                        own = [(k, a - low, b - low) for k, a, b in spans if low <= a and b <= high]
                        if sum(a < high and b > low for _, a, b in spans) == len(own):
                            rows.append((t[low:high], [f"{k} {a} {b}" for k, a, b in own]))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.string()))], names=["region", "spans"])

    sample = docs.select(F.col(text).alias("__text")).mapInArrow(run, "region string, spans array<string>")
    sample = sample.withColumn("place", F.xxhash64("region")).withColumn("share", F.pmod("place", F.lit(FIT_SHARES)))
    order = Window.partitionBy("share").orderBy("place", "region")  # every task sends a bounded number of each share to a shuffle
    sample = sample.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= -(-fit_regions // FIT_SHARES)).orderBy("place", "region")
    return [(r.region, [tuple(map(int, s.split())) for s in r.spans]) for r in sample.collect()]


_NETWORKS: dict[str, Network] = {}


def _network(key: str, shared) -> Network:
    if key not in _NETWORKS:
        _NETWORKS.clear()
        _NETWORKS[key] = shared.value
    return _NETWORKS[key]


def detect(docs: DataFrame, net: Network, text: str = "text") -> DataFrame:
    """doc_id, counts of base spans, base_sha256 and spans. The network has a fixed size and is broadcast."""
    shared, key = docs.sparkSession.sparkContext.broadcast(net), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = _network(key, shared)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                found = find_spans(net, part.column(1).to_pylist())
                counts = [[sum(s[0] == k for s in base) for base, _ in found] for k in range(len(KINDS))]
                digests = [hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array([_joined(e) for _, e in found], pa.string())],
                    names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select("doc_id", F.col(text).alias("__text")).mapInArrow(run, f"doc_id {kind}, {counts}, base_sha256 string, spans string")


def masked(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """The text with every span replaced by its kind; overlapping spans go together, under the first one's kind."""
    if not spans:
        return text
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], s[2])):
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind]}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, net: Network, text: str = "text") -> DataFrame:
    """The rows and columns of `docs` with all spans of `text` masked."""
    shared, key = docs.sparkSession.sparkContext.broadcast(net), uuid.uuid4().hex
    column = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = _network(key, shared)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                texts = part.column(column).to_pylist()
                clean = [masked(t, every) for t, (_, every) in zip(texts, find_spans(net, texts))]
                yield part.set_column(column, part.schema.field(column), pa.array(clean, part.schema.field(column).type))

    return docs.mapInArrow(run, docs.schema)


def personal_data(docs: DataFrame) -> DataFrame:
    """Train on a bounded sample of regions, then find the spans of every whole text."""
    return detect(docs, train(labelled_regions(docs)))
