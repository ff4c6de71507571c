"""Toxicity: a convolutional text classifier over hashed word embeddings.

A word (a run of digits, letters and bytes from 0x80; A-Z in lower case) is embedded as the sum
of the table rows that its whole and its first 4, 5 and 6 bytes hash to, so inflected forms share
rows. Filters of WIDTHS words slide over a whole text, and the maximum of each over the text
feeds a logistic layer. Words are cut and hashed by prefix sums over the bytes of many texts at
once; texts over PIECE bytes are read in pieces that overlap by two words, so that the maximum is
that of the whole text. Training takes every labelled row that is not held out, whatever its length
or number: those whose id's hash is 4 modulo 5 calibrate, all others train. Up to SHARD rows of
LOCAL_BYTES are trained on the driver; more are dealt by the id's hash into shards of about SHARD rows (SHARDS
of them at most, which then grow), each of which makes an epoch of its own from the common state, and after each epoch the
states are averaged by their rows. The first log odds are counted over all training rows. The intercept
is moved to the classes' shares among all labelled rows. A threshold for each language is calibrated on all
calibration rows: of those with the fewest weighted errors, the one nearest to 0.5 (beyond one
shard, of the thousandths from 0.05 to 0.95). Languages select thresholds only; they are no input of a score.

Defined results: null and empty texts are scored as a text without words; a null id is held out
of training; labels that are null, or without both classes, train nothing and all scores are the
share of label 1 among the labels (0 without labels); a repeated id uses each of its rows, with each
of its labels; a language without calibration rows, or a null one, has the threshold 0.5; an empty table gives
no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliograph.llm.common import as_rows, lean, table, text_key, text_of, with_small_batches
from foliograph.session import discard, stored

SHARD, SHARDS, LOCAL_BYTES = 4000, 256, 1 << 24
PIECE, BATCH_BYTES = 1 << 18, 1 << 18
PIECE_WORDS = 1 << 15
ROW_BITS, DIMS, FILTERS, WIDTHS = 16, 8, 8, (1, 2, 3)
PREFIXES = (4, 5, 6)
EPOCHS, DOCS_A_STEP, RATE = 12, 32, 0.08

_BASE = 0x9E3779B97F4A7C15 | 1
_CODES = np.zeros(256, dtype=np.uint64)
for _c in (*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)):
    _CODES[_c] = _c
_CODES[0x41:0x5B] = np.arange(0x61, 0x7B)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, up to n."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def word_rows(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(table rows of each word, where each word starts)."""
    codes = _CODES[np.frombuffer(raw, dtype=np.uint8)]
    inside = np.r_[False, codes > 0, False]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    up, down = _power_tables(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(codes * up[: len(codes)], out=sums[1:])
    rows = np.empty((len(start), 1 + len(PREFIXES)), dtype=np.int32)
    for k, last in enumerate([end, *(np.minimum(start + p, end) for p in PREFIXES)]):
        h = (sums[last] - sums[start]) * down[start] + np.uint64((0x632BE59BD9B4E019 * (k + 1)) % (1 << 64))
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x94D049BB133111EB)
        rows[:, k] = (h >> np.uint64(64 - ROW_BITS)).astype(np.int32)
    return rows, start


_WORD = _CODES > 0


def pieces(raw: bytes, limit: int = PIECE) -> list[bytes]:
    """A text in pieces of about `limit` bytes (three words at least), each from the start of a word; each repeats the last two words before it."""
    if len(raw) <= limit:
        return [raw]
    inside = _WORD[np.frombuffer(raw, dtype=np.uint8)]
    starts = np.flatnonzero(inside & ~np.r_[False, inside[:-1]])
    if not len(starts):
        return [b""]
    out, first = [], 0
    while True:
        last = max(first + 3, int(np.searchsorted(starts, starts[first] + limit)))
        if last >= len(starts):
            return [*out, raw[starts[first] :]]
        out.append(raw[starts[first] : starts[last]])
        first = last - 2


@dataclass
class Model:
    rows: np.ndarray
    filters: dict[int, np.ndarray]  # width -> (width * DIMS, FILTERS)
    bias: np.ndarray
    weight: np.ndarray
    intercept: float
    prior: float = 0.0
    trained: bool = True
    thresholds: dict[str, float] = field(default_factory=dict)

    def maps(self, rows: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(embeddings with two blank ones after each text, filter outputs at each place)."""
        n_pad = 2
        x = np.zeros((len(rows) + n_pad * len(starts), DIMS), dtype=np.float32)
        sizes = np.diff(np.r_[starts, len(rows)])
        place = np.arange(len(rows)) + n_pad * np.repeat(np.arange(len(starts)), sizes)
        inner = np.take(self.rows, rows[:, 0], axis=0)
        for k in range(1, rows.shape[1]):
            inner += np.take(self.rows, rows[:, k], axis=0)
        x[place] = inner
        parts = x @ np.concatenate([self.filters[w][j * DIMS : (j + 1) * DIMS] for w in WIDTHS for j in range(w)], axis=1)
        out = np.empty((len(x), FILTERS * len(WIDTHS)), dtype=np.float32)
        part = 0
        for k, width in enumerate(WIDTHS):
            y = out[:, k * FILTERS : (k + 1) * FILTERS]
            y[...] = parts[:, part : part + FILTERS]
            for j in range(1, width):
                y[:-j] += parts[j:, part + j * FILTERS : part + (j + 1) * FILTERS]
            part += width * FILTERS
        for blank in range(1, n_pad + 1):  # which would else see the words of the next text
            out[np.r_[starts[1:], len(rows)] + n_pad * np.arange(1, len(starts) + 1) - blank] = 0
        return x, out

    def pooled(self, rows: np.ndarray, starts: np.ndarray, goes_on: np.ndarray) -> np.ndarray:
        """The maximum of each filter over each piece; the last two words of a piece that goes on are left to the next one."""
        _, out = self.maps(rows, starts)
        first = starts + 2 * np.arange(len(starts))
        after = np.r_[first[1:], len(out)][goes_on] - 2
        for k in (1, 2):
            out[after - k] = -np.inf
        return np.maximum.reduceat(out, first, axis=0)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not self.trained:
            return np.full(len(texts), self.prior)
        best = np.full((len(texts), FILTERS * len(WIDTHS)), -np.inf, dtype=np.float32)
        batch: list[tuple[int, bytes, bool]] = []

        def flush() -> None:
            rows, starts = _flat([p for _, p, _ in batch])
            np.maximum.at(best, [i for i, _, _ in batch], self.pooled(rows, starts, np.array([g for *_, g in batch])))
            batch.clear()

        size = 0
        for i, raw in enumerate(texts):
            cut = pieces(raw)
            for k, p in enumerate(cut, 1):
                if batch and size + len(p) > BATCH_BYTES:
                    flush()
                    size = 0
                batch.append((i, p, k < len(cut)))
                size += len(p)
        if batch:
            flush()
        z = np.maximum(best + self.bias, 0).astype(np.float64) @ self.weight + self.intercept
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _flat(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the words of all texts, and where each text's rows start."""
    rows, at = word_rows(b"\n".join(texts))
    begins = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
    return rows, np.searchsorted(at, begins)


def _each_rows(texts: list[bytes]) -> list[np.ndarray]:
    """The rows of each text's words; texts are cut together, up to BATCH_BYTES at a time, which takes a third of the time of one by one."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        end, size = at + 1, len(texts[at])
        while end < len(texts) and size + len(texts[end]) < BATCH_BYTES:
            size += len(texts[end]) + 1
            end += 1
        rows, starts = _flat(texts[at:end])
        out += np.split(rows, starts[1:])
        at = end
    return out


def _untrained(prior: float) -> Model:
    empty = np.zeros(0, np.float32)
    return Model(empty, {}, empty, empty, 0.0, prior, False)


def _seen(each: Iterator[tuple[np.ndarray, float]]) -> np.ndarray:
    """For each label, the number of texts that have each row."""
    seen, has = np.zeros((2, 1 << ROW_BITS)), np.zeros(1 << ROW_BITS, dtype=bool)
    for rows, y in each:
        has[rows] = True
        seen[int(y), np.flatnonzero(has)] += 1
        has[rows] = False
    return seen


def _in_pieces(each: list[np.ndarray], limit: int) -> Iterator[list[tuple[int, int, np.ndarray, bool]]]:
    """Batches of (text, first word, rows, whether the text goes on): texts of over `limit` words in pieces that repeat two words."""
    batch: list[tuple[int, int, np.ndarray, bool]] = []
    size = 0
    for i, rows in enumerate(each):
        at = 0
        while True:
            part = rows[at : at + limit]
            more = at + limit < len(rows)
            if batch and size + len(part) > limit:
                yield batch
                batch, size = [], 0
            batch.append((i, at, part, more))
            size += len(part)
            if not more:
                break
            at += limit - 2
    if batch:
        yield batch


class Trainer:
    """A model with its AdaGrad state."""

    def __init__(self, seen: np.ndarray, n: np.ndarray, seed: int = 0):
        """seen: for each label, texts that have each row; n: texts of each label. The first dimension starts at the smoothed log odds."""
        rng = np.random.default_rng(seed)
        m = Model(
            rng.normal(0, 0.05, (1 << ROW_BITS, DIMS)).astype(np.float32), {w: rng.normal(0, 0.3, (w * DIMS, FILTERS)).astype(np.float32) for w in WIDTHS},
            np.zeros(FILTERS * len(WIDTHS), np.float32), np.full(FILTERS * len(WIDTHS), 0.2), 0.0,
        )
        odds = np.log((seen[1] / max(n[1], 1) + 2e-3) / (seen[0] / max(n[0], 1) + 2e-3))
        m.rows[:, 0] = np.clip(odds, -2, 2) / 2
        for w in WIDTHS:
            m.filters[w][:DIMS] = np.abs(m.filters[w][:DIMS]) * (np.arange(DIMS) == 0)[:, None] + m.filters[w][:DIMS] * (np.arange(DIMS) > 0)[:, None]
        self.model, self.square0 = m, 1e-6
        self.squares = [np.full(p.shape, 1e-6, dtype=np.float32) for p in self.params()]

    def params(self) -> list[np.ndarray]:
        m = self.model
        return [m.rows, *m.filters.values(), m.bias, m.weight]

    def state(self) -> np.ndarray:
        return np.concatenate([*(p.ravel().astype(np.float64) for p in (*self.params(), *self.squares)), [self.model.intercept, self.square0]])

    def load(self, state: np.ndarray) -> Trainer:
        at = 0
        for p in (*self.params(), *self.squares):
            p[...] = state[at : at + p.size].reshape(p.shape)
            at += p.size
        self.model.intercept, self.square0 = float(state[at]), float(state[at + 1])
        return self

    def tops(self, each: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(the highest output of each filter over each text, the word where it stands)."""
        n = FILTERS * len(WIDTHS)
        best, word = np.full((len(each), n), -np.inf, dtype=np.float32), np.zeros((len(each), n), dtype=np.int64)
        for batch in _in_pieces(each, PIECE_WORDS):
            sizes = np.array([len(rows) for _, _, rows, _ in batch])
            starts = np.cumsum(sizes) - sizes
            _, out = self.model.maps(np.concatenate([rows for _, _, rows, _ in batch]), starts)
            first = starts + 2 * np.arange(len(batch))
            for (i, at, _, more), a, b in zip(batch, first, np.r_[first[1:], len(out)], strict=True):
                part = out[a : b - 4 if more else b]  # the last two words and the blanks of a piece that goes on are the next one's
                top = part.argmax(axis=0)
                value = part[top, np.arange(n)]
                higher = value > best[i]
                best[i, higher], word[i, higher] = value[higher], at + top[higher]
        return best, word

    def step(self, each: list[np.ndarray], labels: np.ndarray, rate: float) -> None:
        m = self.model
        best, word = self.tops(each)
        places = word[:, :, None] + np.arange(max(WIDTHS))
        inside = places < np.array([len(r) for r in each])[:, None, None]
        rows = np.zeros((*places.shape, 1 + len(PREFIXES)), dtype=np.int32)
        for i, r in enumerate(each):
            rows[i][inside[i]] = r[places[i][inside[i]]]
        x = m.rows[rows].sum(axis=3) * inside[..., None]
        h = best + m.bias
        live = h > 0
        act = np.where(live, h, 0).astype(np.float64)
        p = 1 / (1 + np.exp(-np.clip(act @ m.weight + m.intercept, -40, 40)))
        err = (p - labels) / len(each)
        params = self.params()
        grads = [None] * len(params)
        grads[-1] = act.T @ err + 1e-4 * m.weight
        gh = np.where(live, err[:, None] * m.weight[None, :], 0).astype(np.float32)
        grads[-2] = gh.sum(axis=0)
        back = np.zeros(x.shape, dtype=np.float32)
        for k, w in enumerate(WIDTHS):
            own = slice(k * FILTERS, (k + 1) * FILTERS)
            g = np.zeros_like(m.filters[w])
            for j in range(w):
                g[j * DIMS : (j + 1) * DIMS] = np.einsum("dfe,df->ef", x[:, own, j], gh[:, own])
                back[:, own, j] = gh[:, own, None] * m.filters[w][j * DIMS : (j + 1) * DIMS].T[None]
            grads[1 + k] = g + 1e-5 * m.filters[w]
        keep = inside & (np.abs(back).sum(axis=3) > 0)
        touched, inverse = np.unique(rows[keep].ravel(), return_inverse=True)
        g_rows = np.zeros((len(touched), DIMS), dtype=np.float32)
        np.add.at(g_rows, inverse.ravel(), np.repeat(back[keep], rows.shape[-1], axis=0))
        self.squares[0][touched] += g_rows**2
        m.rows[touched] -= 0.3 * rate * g_rows / np.sqrt(self.squares[0][touched] + 1e-4)
        for q, (param, g) in enumerate(zip(params[1:], grads[1:], strict=True), 1):
            self.squares[q] += g**2
            param -= (rate * g / np.sqrt(self.squares[q] + 1e-6)).astype(param.dtype)
        g0 = err.sum()
        self.square0 += g0 * g0
        m.intercept -= rate * g0 / np.sqrt(self.square0 + 1e-6)

    def done(self, share: float, prior: float) -> Model:
        """The model, its intercept moved from the share of label 1 in training to the prior."""
        self.model.intercept += float(np.log(prior / (1 - prior)) - np.log(share / (1 - share)))
        self.model.prior = prior
        return self.model


def _rate(epoch: int) -> float:
    return RATE * (1 - epoch / (EPOCHS + 2))


def fit(texts: list[bytes], labels: np.ndarray, prior: float, seed: int = 0) -> Model:
    """Train on whole texts; prior: the share of label 1 that scores should assume."""
    labels = np.asarray(labels, dtype=np.float64)
    if not len(labels) or not 0 < labels.mean() < 1:
        return _untrained(prior)
    rng = np.random.default_rng(seed)
    each = _each_rows(texts)
    made = Trainer(_seen(zip(each, labels, strict=True)), np.array([(1 - labels).sum(), labels.sum()]), seed)
    for epoch in range(EPOCHS):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), DOCS_A_STEP):
            part = order[at : at + DOCS_A_STEP]
            made.step([each[i] for i in part], labels[part], _rate(epoch))
    return made.done(labels.mean(), prior)


def calibrate(scores: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> float:
    """Of the thresholds with the least weighted errors of `score >= threshold`, the one nearest to 0.5."""
    order = np.sort(np.unique(scores))
    cuts = np.unique(np.clip(np.r_[0.5, (order[1:] + order[:-1]) / 2], 0.05, 0.95))
    wrong = [weights[(scores >= c) != (labels == 1)].sum() for c in cuts]
    best = np.flatnonzero(np.isclose(wrong, min(wrong)))
    return float(cuts[best[np.abs(cuts[best] - 0.5).argmin()]])


_BLOCKS = 64
_PARTS = "block int, shard int, part binary"
#: Thresholds that are tried beyond one shard.
CUTS = np.arange(50, 951) / 1000


def _added(parts: DataFrame) -> np.ndarray:
    """The sum of vectors that come in blocks, always in the order of shards."""

    @lean
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for block, part in zip(b.column(0).to_pylist(), b.column(2), strict=True):
                v = np.frombuffer(part.as_py())
                sums[block] = sums[block] + v if block in sums else v
        yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["block", "part"])

    found = parts.repartition("block").sortWithinPartitions("block", "shard").mapInArrow(add, "block int, part binary").collect()
    return np.concatenate([np.frombuffer(bytes(r.part)) for r in sorted(found, key=lambda r: r.block)])


def _over_shards(rows: DataFrame, shards: int, seed: int, begin: Callable[[], object], take: Callable, end: Callable[[object, int], np.ndarray]) -> np.ndarray:
    """The sum of the vectors of all shards: `take` sees DOCS_A_STEP rows of one shard at a time, in an order that `seed` and the ids fix."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, n = None, None, 0
        held: list[tuple[bytes, float]] = []

        def taken() -> None:
            take(state, list(zip(_each_rows([t for t, _ in held]), (y for _, y in held), strict=True)))
            held.clear()

        def out() -> Iterator[pa.RecordBatch]:
            if held:
                taken()
            for block, v in enumerate(np.array_split(end(state, n), _BLOCKS)):
                yield pa.record_batch([pa.array([block], pa.int32()), pa.array([now], pa.int32()), pa.array([v.tobytes()], pa.binary())], names=["block", "shard", "part"])

        for b in batches:
            for shard, text, y in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), b.column(2).to_pylist(), strict=True):
                if shard != now:
                    if now is not None:
                        yield from out()
                    now, state, n = shard, begin(), 0
                held.append((text.as_py(), y))
                n += 1
                if len(held) == DOCS_A_STEP:
                    taken()
        if now is not None:
            yield from out()

    dealt = rows.repartition(shards, "shard").sortWithinPartitions("shard", F.xxhash64("key", F.lit(seed)), "key", "text_key", "y")
    return _added(with_small_batches(dealt.select("shard", "text", "y")).mapInArrow(run, _PARTS))


def _fit_shards(rows: DataFrame, n: np.ndarray, prior: float, shards: int) -> Model:
    """Train on all rows (shard, key, text_key, text, y); n: rows of each label."""

    def count(seen: np.ndarray, part: list[tuple[np.ndarray, float]]) -> None:
        seen += _seen(part)

    seen = _over_shards(rows, shards, 0, lambda: np.zeros((2, 1 << ROW_BITS)), count, lambda seen, _: seen.ravel()).reshape(2, -1)
    made = Trainer(seen, n)
    for epoch in range(EPOCHS):
        shipped, rate = rows.sparkSession.sparkContext.broadcast(made.state().astype(np.float32)), _rate(epoch)
        step = lambda t, part: t.step([r for r, _ in part], np.array([y for _, y in part], dtype=np.float64), rate)  # noqa: B023, E731
        begin = lambda: Trainer(np.zeros((2, 1 << ROW_BITS)), np.zeros(2)).load(shipped.value)  # noqa: B023, E731
        made.load(_over_shards(rows, shards, epoch + 1, begin, step, lambda t, k: t.state() * k) / n.sum())
        shipped.destroy()
    return made.done(n[1] / n.sum(), prior)


def _calibrate_all(rows: DataFrame, model: Model, prior: float) -> dict[str, float]:
    """The threshold of each language from counts of all rows (lang, text, y) between CUTS."""
    shipped = rows.sparkSession.sparkContext.broadcast(model)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = shipped.value.scores([t.as_py() for t in b.column(1).cast(pa.binary())])
            yield pa.record_batch([b.column(0), b.column(2), pa.array(np.searchsorted(CUTS, s, side="right"), pa.int32())], names=["lang", "y", "cut"])

    found = with_small_batches(rows.select("lang", "text", "y")).mapInArrow(run, "lang string, y int, cut int").groupBy("lang", "y", "cut").count().collect()
    total = {y: max(1, sum(r["count"] for r in found if r.y == y)) for y in (0, 1)}
    counts: dict[str, np.ndarray] = {}
    for r in found:
        counts.setdefault(r.lang, np.zeros((2, len(CUTS) + 1)))[r.y, r.cut] += r["count"]
    out = {}
    for lang, c in counts.items():
        missed, flagged = np.cumsum(c[1])[:-1], c[0].sum() - np.cumsum(c[0])[:-1]
        wrong = missed * prior / total[1] + flagged * (1 - prior) / total[0]
        best = np.flatnonzero(np.isclose(wrong, wrong.min()))
        out[lang] = float(CUTS[best[np.abs(CUTS[best] - 0.5).argmin()]])
    return out


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", shard: int = SHARD, local_bytes: int = LOCAL_BYTES) -> Model:
    """Fit on all labelled rows of docs that are not held out."""
    usable = labels.filter(f"doc_id IS NOT NULL AND {label_col} IN (0, 1) AND NOT {_HELD_OUT}").select("doc_id", F.col(label_col).cast("int").alias("y"))
    n = {r.y: r["count"] for r in usable.groupBy("y").count().collect()}
    prior = n.get(1, 0) / max(1, sum(n.values()))
    if len(n) < 2:
        return _untrained(prior)
    lang = F.coalesce(F.col("lang"), F.lit("")) if "lang" in docs.columns else F.lit("")
    key = F.xxhash64(F.col("doc_id").cast("string"))
    docs.sparkSession.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")  # an epoch's shuffle files go with it
    rows = docs.select("doc_id", text_of("text").alias("text"), lang.alias("lang")).join(usable, "doc_id")
    rows = stored(rows.select(key.alias("key"), text_key(F.col("text")).alias("text_key"), "text", "lang", "y", (F.pmod(key, F.lit(5)) == 4).alias("apart")), "labelled")
    sizes = rows.groupBy("apart", "y").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text").cast("long")).alias("bytes")).collect()
    if not sizes:
        return _untrained(prior)
    of = {(r.apart, r.y): r.n for r in sizes}
    each = np.array([of.get((False, y), 0) for y in (0, 1)], dtype=np.float64)
    if sum(of.values()) > shard or sum(r.bytes for r in sizes) > local_bytes:
        if not each.all():
            return _untrained(prior)
        shards = int(min(SHARDS, max(1, -(-each.sum() // shard))))
        dealt = rows.filter("NOT apart").withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))
        model = _fit_shards(dealt, each, prior, shards)
        model.thresholds = _calibrate_all(rows.filter("apart"), model, prior)
        discard(rows)
        return model
    got = sorted((r.key, r.text.encode(), r.lang, r.y, r.apart) for r in rows.collect())
    discard(rows)
    learnt, kept = [r for r in got if not r[4]], [r for r in got if r[4]]
    model = fit([r[1] for r in learnt], np.array([r[3] for r in learnt]), prior)
    if model.trained and kept:
        scores, langs, held = model.scores([r[1] for r in kept]), np.array([r[2] for r in kept]), np.array([r[3] for r in kept])
        weights = np.where(held == 1, prior / max(1, (held == 1).sum()), (1 - prior) / max(1, (held == 0).sum()))
        model.thresholds = {str(x): calibrate(scores[langs == x], held[langs == x], weights[langs == x]) for x in np.unique(langs)}
    return model


_HELD_OUT = "crc32(cast(coalesce(cast(doc_id AS string), '') AS binary)) % 5 = 0"
_SCORED = "doc_id long, lang string, score double"


def _with_scores(rows: DataFrame, model: Model) -> DataFrame:
    """(row, score, threshold) of (row, text, lang)."""
    shipped = rows.sparkSession.sparkContext.broadcast(model)  # the tables' size is fixed by ROW_BITS and DIMS
    out_schema = rows.select("row").schema.add("score", "double").add("threshold", "double")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for b in batches:
            s = m.scores([t.as_buffer().to_pybytes() if t.as_buffer() else b"" for t in b.column(1).cast(pa.binary())])
            cut = [m.thresholds.get(x, 0.5) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array(cut, pa.float64())], ["row", "score", "threshold"])

    return with_small_batches(rows).select("row", "text", "lang").mapInArrow(run, out_schema)


def _lang(docs: DataFrame, of: Callable[[str], Column] = F.col) -> Column:
    return (F.coalesce(of("lang"), F.lit("")) if "lang" in docs.columns else F.lit("")).alias("lang")


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted, threshold, rejected) for each row."""
    found = _with_scores(docs.select(F.col("doc_id").alias("row"), text_of("text").alias("text"), _lang(docs)), model).withColumnRenamed("row", "doc_id")
    return found.select("doc_id", F.expr(_HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "threshold", (F.col("score") >= F.col("threshold")).alias("rejected"))


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    """All documents, scored by a classifier of labels.toxic."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return scored(docs, train(docs, table(spark, sf_dir, "labels")))


def toxicity_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the rows whose score reaches their language's threshold; all columns stay, whatever their names."""
    rows, row = as_rows(docs), F.col("row")
    found = _with_scores(rows.select("row", text_of(row.getField("text")).alias("text"), _lang(docs, row.getField)), train(docs, table(spark, sf_dir, "labels")))
    return found.filter("score < threshold").select("row.*")
