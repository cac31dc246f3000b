"""Secrets in whole texts: three patterns, and a character network for what they miss.

``base_spans`` finds assignments, access keys and hex strings. Every run of 16 or more
of the characters that keys are made of is a candidate. A convolutional network in numpy scores each with its context; it is trained here, on
all distinct findings of all rows that the patterns label. Since it is to find what they miss, a labelled secret is shown to it in three forms:
as it stands; without the key word, signs and quotes that gave it away; and so with its value written
in another alphabet. Candidates that the patterns leave are the other class, but for those shaped like a secret
(``shaped``), which may be one. The network's outputs are
calibrated on the findings kept aside, half of them (Platt scaling), and the threshold is the highest that keeps
``recall`` of the positives among those. A run it accepts is a span of its own, unless a base span touches it; base findings
that it accepts are counted as confirmed.

Spans are (kind, start, end) in code points, the end exclusive. A null text counts as empty. Where
too few findings are labelled (``LEAST_LABELLED`` of either label) no network is trained, and it adds nothing. Runs of any length
are learned and scored whole, in batches of ``BATCH`` pieces.

Findings stay in a table. They are dealt to shards of about ``SHARD``; in each round every shard goes once through all of its own, from the same
weights, and the weights and the optimiser's moments are then averaged, each shard by its number of findings. Sums over shards and over the
findings kept aside are taken in decimals, so that they don't depend on the order of tasks. The driver holds weights and sums only.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm.session import discard, materialise, release, ship, table, tidy

KINDS = ("assign", "access", "hex", "network")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_ALPHABETS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-", "0123456789ABCDEF")
LEAST_LABELLED = 20
#: Findings that one task goes through in a round, about.
SHARD = 4096
#: Code points of context on either side.
CONTEXT = 24
WIDTH, EMBEDDING, FILTERS, PIECE, BATCH = 5, 8, 24, 96, 512
WEIGHTS = ("embed", "role", "kernel", "bias", "out", "shift")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by start, then kind."""
    found = [(0, *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(1, *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(2, *m.span()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], s[0]))


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Runs that no base span touches."""
    opens, closes = [], []
    for _, start, end in base:
        if closes and start <= closes[-1]:
            closes[-1] = max(closes[-1], end)
        else:
            opens.append(start)
            closes.append(end)
    out = []
    for m in _CANDIDATE.finditer(text):
        at = bisect.bisect_right(closes, m.start())
        if at == len(opens) or opens[at] >= m.end():
            out.append(m.span())
    return out


def shaped(run: str) -> bool:
    """Whether a run looks like a secret: letters and four digits or more, or capitals, small letters and digits mixed."""
    digits = sum(c.isdigit() for c in run)
    letters = {c.isupper() for c in run if c.isalpha()}
    return (digits >= 4 and bool(letters)) or (len(letters) == 2 and digits > 0)


def shown(text: str, span: tuple[int, int, int]) -> list[tuple[str, int, int]]:
    """The forms in which a base finding is learned: (text, start, end) of its value and context."""
    start, end = value_span(text, span)
    value, before, after = text[start:end], text[max(0, span[1] - CONTEXT) : span[1]], text[end : end + CONTEXT].lstrip("\"'")
    digest = hashlib.shake_256(value.encode()).digest(len(value))
    alphabet = _ALPHABETS[digest[0] % len(_ALPHABETS)]
    other = "".join(alphabet[x % len(alphabet)] for x in digest)
    low = max(0, start - CONTEXT)
    return [(text[low : end + CONTEXT], start - low, end - low), (before + value + after, len(before), len(before) + len(value)), (before + other + after, len(before), len(before) + len(value))]


def value_span(text: str, span: tuple[int, int, int]) -> tuple[int, int]:
    """Where the secret itself is in a base finding."""
    kind, start, end = span
    return _ASSIGN.match(text, start).span(2) if kind == 0 else (start, end)


def codes(text: str, start: int, end: int) -> np.ndarray:
    """Rows (character class, inside the candidate) of a candidate with its context."""
    low, high = max(0, start - CONTEXT), min(len(text), end + CONTEXT)
    raw = np.frombuffer(text[low:high].encode("utf-32-le"), "<u4")
    inside = np.zeros(len(raw), np.uint8)
    inside[start - low : end - low] = 1
    return np.stack([np.where((raw >= 32) & (raw < 127), raw - 31, np.where(raw < 32, 96, 0)).astype(np.uint8), inside])


def starts(found: np.ndarray) -> range:
    """Where the pieces of a finding begin."""
    return range(0, max(1, found.shape[1] - WIDTH + 1), PIECE)


@dataclass
class Network:
    """Embedding, one convolution, the maximum over all places, and a logistic output."""

    embed: np.ndarray
    role: np.ndarray
    kernel: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    shift: np.ndarray
    scale: float = 1.0
    offset: float = 0.0
    threshold: float = 1.0

    @classmethod
    def fresh(cls, seed: int) -> Network:
        r = np.random.default_rng(seed)
        return cls(r.normal(0, 0.3, (97, EMBEDDING)), r.normal(0, 0.3, (2, EMBEDDING)), r.normal(0, (WIDTH * EMBEDDING) ** -0.5, (WIDTH * EMBEDDING, FILTERS)), np.zeros(FILTERS), r.normal(0, 0.3, FILTERS), np.zeros(1))

    def pooled(self, found: list[np.ndarray]) -> tuple[np.ndarray, list]:
        """Filters' maxima for each finding, over pieces of at most PIECE places that overlap by a kernel's width."""
        owner = np.repeat(np.arange(len(found)), [len(starts(f)) for f in found])
        top, rest = self._tops([f[:, at : at + PIECE + WIDTH - 1] for f in found for at in starts(f)])
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        return np.maximum.reduceat(top, first, axis=0), [*rest, top, owner]

    def _tops(self, pieces: list[np.ndarray]) -> tuple[np.ndarray, list]:
        longest = max(max(p.shape[1] for p in pieces), WIDTH)
        chars, role, real = np.zeros((len(pieces), longest), np.int64), np.zeros((len(pieces), longest), np.int64), np.zeros((len(pieces), longest - WIDTH + 1), bool)
        for i, p in enumerate(pieces):
            chars[i, : p.shape[1]], role[i, : p.shape[1]] = p
            real[i, : max(1, p.shape[1] - WIDTH + 1)] = True
        x = self.embed[chars] + self.role[role]
        view = np.lib.stride_tricks.sliding_window_view(x, WIDTH, axis=1).transpose(0, 1, 3, 2).reshape(len(pieces), longest - WIDTH + 1, -1)
        act = np.where(real[:, :, None], np.maximum(view @ self.kernel + self.bias, 0), -1.0)
        best = act.argmax(axis=1)
        return np.take_along_axis(act, best[:, None], 1)[:, 0], [chars, role, view, best]

    def logits(self, found: Iterable[np.ndarray]) -> np.ndarray:
        """Of findings as they come: no more than BATCH pieces, of few or of one, are held at once."""
        out: list[np.ndarray] = []
        pieces: list[np.ndarray] = []
        owner: list[int] = []

        def flush() -> None:
            for i, top in zip(owner, self._tops(pieces)[0] if pieces else ()):
                out[i] = np.maximum(out[i], top)
            pieces.clear()
            owner.clear()

        for i, f in enumerate(found):
            out.append(np.full(FILTERS, -np.inf))
            for at in starts(f):
                pieces.append(f[:, at : at + PIECE + WIDTH - 1])
                owner.append(i)
                if len(pieces) == BATCH:
                    flush()
        flush()
        return np.array(out).reshape(-1, FILTERS) @ self.out + self.shift

    def probabilities(self, found: Iterable[np.ndarray]) -> np.ndarray:
        return sigmoid(self.logits(found) * self.scale + self.offset)

    def winners(self, found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Filters' maxima for each finding, with the characters and roles at the first place that reaches each. No more than BATCH pieces are held at once."""
        best = np.full((len(found), FILTERS), -np.inf)
        chars, role = np.zeros((2, len(found), FILTERS, WIDTH), np.int64)
        pieces = [(o, at) for o, f in enumerate(found) for at in starts(f)]
        for low in range(0, len(pieces), BATCH):
            part = pieces[low : low + BATCH]
            top, (c, r, _, place) = self._tops([found[o][:, at : at + PIECE + WIDTH - 1] for o, at in part])
            window = np.arange(len(part))[:, None, None], place[:, :, None] + np.arange(WIDTH)
            c, r = c[window], r[window]
            first = np.array([at == 0 for _, at in part])
            own = [o for o, at in part if at == 0]
            best[own], chars[own], role[own] = top[first], c[first], r[first]
            for i in np.flatnonzero(~first):
                o = part[i][0]
                use = top[i] > best[o]
                best[o, use], chars[o, use], role[o, use] = top[i, use], c[i, use], r[i, use]
        return best, chars, role

    def step(self, found: list[np.ndarray], label: np.ndarray) -> list[np.ndarray]:
        """Gradients of the mean log loss."""
        pool, chars, role = self.winners(found)
        p = sigmoid(pool @ self.out + self.shift)
        error = (p - label) / len(label)
        # A filter's gradient flows to the place of its maximum.
        flow = np.where(pool > 0, error[:, None] * self.out, 0)
        seen = (self.embed[chars] + self.role[role]).reshape(*flow.shape, WIDTH * EMBEDDING)
        kernel = np.einsum("nf,nfk->kf", flow, seen)
        inner = (flow[:, :, None] * self.kernel.T).reshape(-1, EMBEDDING)
        embed, roles = (_sums(of.ravel(), inner, len(rows)) for of, rows in ((chars, self.embed), (role, self.role)))
        return [embed, roles, kernel, flow.sum(axis=0), pool.T @ error, np.array([error.sum()])]

    def weights(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in WEIGHTS])

    def with_weights(self, flat: np.ndarray) -> Network:
        parts = np.split(flat, np.cumsum([getattr(self, n).size for n in WEIGHTS])[:-1])
        return replace(self, **{n: x.reshape(getattr(self, n).shape) for n, x in zip(WEIGHTS, parts)})


def _sums(of: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """The sum of the rows that belong to each of n."""
    width = rows.shape[1]
    return np.bincount((of[:, None] * width + np.arange(width)).ravel(), rows.ravel(), n * width).reshape(n, width)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _exact(c: Column) -> Column:
    """The sum of a column, whatever the order of its rows."""
    return F.sum(c.cast("decimal(38,18)")).cast("double")


def _platt(scored: DataFrame, n: tuple[int, int]) -> tuple[float, float]:
    """Scale and offset of the logits z that fit the labels best, by Newton steps that are halved where they overshoot; n rows have each label."""
    # Platt's targets keep the fit finite where the labels are parted without error.
    z, goal = F.col("z"), F.when(F.col("label") == 1, F.lit((n[1] + 1) / (n[1] + 2))).otherwise(F.lit(1 / (n[0] + 2)))

    def measured(a: float, b: float) -> tuple[float, np.ndarray, np.ndarray]:
        """Loss, gradient, and the matrix of second derivatives."""
        u = z * a + b
        p = F.lit(1.0) / (F.exp(-u) + 1)
        w, e = p * (F.lit(1.0) - p), p - goal
        loss = F.greatest(u, F.lit(0.0)) + F.log1p(F.exp(-F.abs(u))) - goal * u
        x, ez, eo, wzz, wz, wo = scored.agg(*[_exact(c).alias(f"c{i}") for i, c in enumerate((loss, e * z, e, w * z * z, w * z, w))]).first()
        return x + 5e-4 * a * a, np.array([ez + 1e-3 * a, eo]), np.array([[wzz + 1e-3, wz], [wz, wo + 1e-6]])

    a, b = 1.0, 0.0
    now, slope, bend = measured(a, b)
    for _ in range(50):
        da, db = np.linalg.solve(bend, slope)
        part = 1.0
        while (then := measured(float(a - part * da), float(b - part * db)))[0] > now and part > 1e-6:
            part /= 2
        if then[0] > now:
            break
        a, b = float(a - part * da), float(b - part * db)
        now, slope, bend = then
        if part * (abs(da) + abs(db)) < 1e-9:
            break
    return a, b


def _ranked(z: DataFrame, rank: int) -> float:
    """The value in column z that has this many lesser ones before it, by counts of 16 bits at a time."""
    found = 0
    for shift in (48, 32, 16, 0):
        groups = z.groupBy(F.shiftright("order", shift).alias("high")).count().collect()
        for high, n in sorted(map(tuple, groups)):
            if rank < n:
                break
            rank -= n
        z, found = z.where(F.shiftright("order", shift) == high), high
    return float(_ordered(np.array([found], np.int64)).view(np.float64)[0])


def _ordered(bits: np.ndarray) -> np.ndarray:
    """Bits of doubles as whole numbers of the same order, and back."""
    return bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))


def learn(state: np.ndarray, net: Network, found: list[np.ndarray], label: np.ndarray, r: np.random.Generator) -> np.ndarray:
    """The state (weights, their two moments, number of steps) after each finding was shown once, 64 at a time."""
    flat, first, second, t = *np.split(state[:-1], 3), state[-1]
    order = r.permutation(len(found))
    for at in range(0, len(order), 64):
        pick = order[at : at + 64]
        g = np.concatenate([x.ravel() for x in net.with_weights(flat).step([found[i] for i in pick], label[pick])])
        t += 1
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        flat = flat - 0.01 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return np.concatenate([flat, first, second, [t]])


def _round(shards: DataFrame, total: int, net: Network, state: np.ndarray, seed: list[int]) -> np.ndarray:
    """The mean state after every shard has learned its own findings, weighted by their numbers."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in ("text", "start", "end", "label")])
        own = [codes(t, s, e) for t, s, e in zip(*(rows.column(c).to_pylist() for c in ("text", "start", "end")))]
        r = np.random.default_rng([*seed, rows.column("shard")[0].as_py()])
        after = learn(state, net, own, rows.column("label").to_numpy().astype(np.float64), r)
        release()
        return pa.table({"at": np.arange(len(after)), "part": after * (len(own) / total)})

    parts = shards.groupBy("shard").applyInArrow(run, "at long, part double").groupBy("at").agg(_exact(F.col("part")))
    return np.array([x for _, x in sorted(map(tuple, parts.collect()))])


def train(found: DataFrame, recall: float = 0.98, epochs: int = 8, seed: int = 7) -> Network | None:
    """A network fitted on the rows of ``labelled_findings`` that aren't ``aside``, calibrated on those that are."""
    n = {(r["aside"], r["label"]): r["count"] for r in found.groupBy("aside", "label").count().collect()}
    if min(n.get((False, y), 0) for y in (0, 1)) < LEAST_LABELLED / 2 or min(n.get((True, y), 0) for y in (0, 1)) < LEAST_LABELLED / 4:
        return None
    total = n[False, 0] + n[False, 1]
    count = math.ceil(total / SHARD)
    # By a number of partitions that adaptive execution doesn't put together again: shards are little data, but work.
    shards = found.where(~F.col("aside")).withColumn("shard", F.pmod(F.xxhash64("text", "start", "end"), F.lit(count))).repartition(count, "shard")
    net = Network.fresh(seed)
    state = np.concatenate([net.weights(), np.zeros(2 * net.weights().size + 1)])
    for epoch in range(epochs):
        state = _round(shards, total, net, state, [seed, epoch])
    net = net.with_weights(state[: net.weights().size])

    @tidy
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = net.logits(codes(t, s, e) for t, s, e in zip(*(batch.column(c).to_pylist() for c in ("text", "start", "end"))))
            yield pa.record_batch([pa.array(z), pa.array(_ordered(z.view(np.int64))), batch.column("label")], ["z", "order", "label"])

    scored = materialise(found.where("aside").select("text", "start", "end", "label").mapInArrow(score, "z double, order long, label long"), "secret-scores")
    net.scale, net.offset = a, b = _platt(scored, (n[True, 0], n[True, 1]))
    rank = math.floor((1 - recall) * n[True, 1])
    edge = _ranked(scored.where("label = 1"), rank if a >= 0 else n[True, 1] - 1 - rank)
    net.threshold = float(sigmoid(np.float64(a * edge + b)))
    discard(scored)
    return net


def labelled_findings(docs: DataFrame) -> DataFrame:
    """(text, start, end, label, aside) of all distinct findings of all rows, stored; text is the value with its context. All forms of a secret are on one side."""
    ship(docs.sparkSession)

    def side(value: str) -> bool:
        return hashlib.sha256(value.encode()).digest()[0] % 2 == 0

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = set()
                for text in batch.column("text").slice(at, 512).to_pylist():
                    if not text:
                        continue
                    base = base_spans(text)
                    for s in base:
                        aside = side(text[slice(*value_span(text, s))])
                        rows |= {(*form, 1, aside) for form in shown(text, s)}
                    for start, end in candidates(text, base):
                        if not shaped(text[start:end]):
                            low = max(0, start - CONTEXT)
                            own = text[low : end + CONTEXT]
                            rows.add((own, start - low, end - low, 0, side(own)))
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*sorted(rows)), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()))], ["text", "start", "end", "label", "aside"])

    return materialise(docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "text string, start long, end long, label long, aside boolean").distinct(), "secret-findings")


def fit(docs: DataFrame) -> Network | None:
    found = labelled_findings(docs)
    net = train(found)
    discard(found)
    return net


def spans_of(texts: list[str], net: Network | None) -> list[tuple[list, list, int]]:
    """Base spans and all spans of each text, and how many base findings the network confirms."""
    base = [base_spans(t) for t in texts]
    if net is None:
        return [(b, b, 0) for b in base]
    scored = [(i, s, e, False) for i, (t, b) in enumerate(zip(texts, base)) for s, e in candidates(t, b)]
    scored += [(i, *value_span(texts[i], s), True) for i, b in enumerate(base) for s in b]
    added: dict[int, list] = {}
    confirmed = [0] * len(texts)
    p = net.probabilities(codes(texts[i], s, e) for i, s, e, _ in scored)
    for (i, s, e, known), x in zip(scored, p):
        if x >= net.threshold:
            if known:
                confirmed[i] += 1
            else:
                added.setdefault(i, []).append((3, s, e))
    return [(b, sorted(b + added[i], key=lambda s: (s[1], s[0])) if i in added else b, confirmed[i]) for i, b in enumerate(base)]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def scan(docs: DataFrame, net: Network | None, key: str = "doc_id") -> DataFrame:
    """(key, n_assign, n_access, n_hex, n_network, n_confirmed, base_sha256, spans) of each row."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = spans_of([t or "" for t in part.column("text").to_pylist()], shared.value)
                counts = [pa.array([sum(s[0] == k for s in every) for _, every, _ in found], pa.int64()) for k in range(4)]
                digest = pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b, _, _ in found])
                yield pa.record_batch([part.column("key"), *counts, pa.array([n for *_, n in found], pa.int64()), digest, pa.array([joined(e) for _, e, _ in found])], [key, "n_assign", "n_access", "n_hex", "n_network", "n_confirmed", "base_sha256", "spans"])

    source = docs.select(F.col(key).cast("long").alias("key"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, f"{key} long, n_assign long, n_access long, n_hex long, n_network long, n_confirmed long, base_sha256 string, spans string")


def redact(docs: DataFrame, net: Network | None, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span replaced by ``mark``, overlapping ones by one; all columns stay, n_chars as the new length."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)
    names = docs.columns
    place = names.index(text)

    def clean(t: str, spans: list) -> str:
        out, at = [], 0
        for _, s, e in spans:
            if s >= at:
                out += [t[at:s], mark]
            at = max(at, e)
        return "".join([*out, t[at:]])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).to_pylist()
            found = spans_of([t or "" for t in texts], shared.value)
            done = pa.array([clean(t, every) if every else t for t, (_, every, _) in zip(texts, found)], pa.string())
            yield pa.RecordBatch.from_arrays([done if i == place else batch.column(i) for i in range(batch.num_columns)], schema=batch.schema)

    clean_rows = docs.mapInArrow(run, docs.schema)
    return clean_rows.withColumn("n_chars", F.length(text).cast("long")).select(*names) if "n_chars" in names else clean_rows


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, by the patterns and a network trained on what they find."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs, fit(docs))
