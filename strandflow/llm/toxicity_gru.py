"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word enters as two vectors: one of its own, and the scaled sum of those of its
character runs of three to five, so unseen forms of a known stem are known. Two
gated recurrent layers read a window forwards and backwards, attention weighs
the places, and a logistic unit scores the pooled state. Windows of ``WINDOW``
words start every ``STRIDE`` words over the whole text; a text's score is that
of its worst window.

The network is trained here, in numpy, on a bounded hash sample of labelled
documents (``SAMPLE_DOCS`` of each class, about, none over ``SAMPLE_WORDS``
words). A toxic document need not be toxic everywhere: after a warm-up on
random windows each document teaches through its worst window, and a clean one
through a random window as well.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.llm.common import remainder, slices
from strandflow.llm.tokens import Numbers

WINDOW, STRIDE = 48, 32
#: Vectors of words and of character runs, and their length.
BUCKETS, DIM = 1 << 14, 8
HIDDEN, ATTENTION = 8, 8
SAMPLE_DOCS, SAMPLE_WORDS = 1500, 4000
#: Steps, about; the passes over the sample follow from them, the first WARM_UP share on random windows.
STEPS, WARM_UP, BATCH, RATE = 400, 0.2, 128, 0.01
#: Words whose inputs a scoring task keeps (some 400 bytes each).
KEPT_WORDS = 250_000
#: Windows scored at once.
WINDOWS_AT_ONCE = 2048
#: Everything in ASCII but letters separates words.
TO_WORDS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def words(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(TO_WORDS).split()


def spread(codes: np.ndarray) -> np.ndarray:
    return (codes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(50)).astype(np.int64)  # 14 bits


def features(new: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each word; buckets of its character runs, and how many they are."""
    own = spread(np.array([zlib.crc32(w) for w in new], dtype=np.uint64))
    raw = np.frombuffer(b"".join(b"<" + w + b">" for w in new), dtype=np.uint8).astype(np.uint64)
    size = np.array([len(w) + 2 for w in new], dtype=np.int64)
    end = np.repeat(np.cumsum(size), size)
    word = np.repeat(np.arange(len(new)), size)
    place = np.arange(len(raw))
    code, found, of = raw.copy(), [], []
    for n in range(1, 5):
        code = code[: len(raw) - n] * np.uint64(257) + raw[n:]
        if n >= 2:
            inside = place[: len(code)] + n < end[: len(code)]
            found.append(spread(code[inside] + np.uint64(n << 48)))
            of.append(word[: len(code)][inside])
    of = np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return own, np.concatenate(found)[order], np.bincount(of, minlength=len(new))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters and the two passes. Windows come longest first, so each step works on a leading slice."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        near = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
        self.key = uuid.uuid4().hex
        self.p = {"word": np.zeros((BUCKETS, DIM), dtype=np.float32), "char": np.zeros((BUCKETS, DIM), dtype=np.float32)}
        for d in "fb":
            self.p |= {f"in_{d}": near(2 * DIM, 3 * HIDDEN), f"rec_{d}": near(HIDDEN, 3 * HIDDEN), f"bias_{d}": np.zeros(3 * HIDDEN, dtype=np.float32)}
        self.p |= {"att": near(2 * HIDDEN, ATTENTION), "att_v": near(ATTENTION), "out": near(2 * HIDDEN), "out_b": np.zeros(1, dtype=np.float32)}

    # --- inputs

    def inputs(self, own: np.ndarray, runs: np.ndarray, count: np.ndarray) -> np.ndarray:
        summed = np.add.reduceat(self.p["char"][runs], np.cumsum(count) - count, axis=0)
        return np.concatenate([self.p["word"][own], summed / np.sqrt(count)[:, None].astype(np.float32)], axis=1)

    def projected(self, x: np.ndarray) -> np.ndarray:
        """What both directions take from an input: computed once for each distinct word."""
        return np.concatenate([x @ self.p["in_f"] + self.p["bias_f"], x @ self.p["in_b"] + self.p["bias_b"]], axis=1)

    # --- passes

    def recur(self, table: np.ndarray, index: np.ndarray, length: np.ndarray, d: str, keep: bool):
        n, steps = index.shape
        rec, h = self.p[f"rec_{d}"], np.zeros((n, HIDDEN), dtype=np.float32)
        states, cache = np.zeros((steps, n, HIDDEN), dtype=np.float32), []
        active = np.searchsorted(-length, -np.arange(steps), side="left")  # windows longer than t
        a, b = (0, 3 * HIDDEN) if d == "f" else (3 * HIDDEN, 6 * HIDDEN)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            m = int(active[t])
            if not m:
                continue
            before = h[:m]
            given, said = table[index[:m, t], a:b], before @ rec
            gates = sigmoid(given[:, : 2 * HIDDEN] + said[:, : 2 * HIDDEN])
            r, z = gates[:, :HIDDEN], gates[:, HIDDEN:]
            new = np.tanh(given[:, 2 * HIDDEN :] + r * said[:, 2 * HIDDEN :])
            out = new + z * (before - new)
            if keep:
                cache.append((t, m, before.copy(), r, z, new, said[:, 2 * HIDDEN :]))
            h[:m] = out
            states[t, :m] = out
        return states, cache

    def forward(self, table: np.ndarray, index: np.ndarray, length: np.ndarray, keep: bool = False):
        """Logits of windows; ``index`` are rows of ``table``, ``length`` descends."""
        f, cache_f = self.recur(table, index, length, "f", keep)
        b, cache_b = self.recur(table, index, length, "b", keep)
        both = np.concatenate([f, b], axis=2)
        inner = np.tanh(both @ self.p["att"])
        score = inner @ self.p["att_v"]
        score[np.arange(len(score))[:, None] >= length] = -np.inf
        weight = np.exp(score - score.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = (weight[:, :, None] * both).sum(axis=0)
        logit = pooled @ self.p["out"] + self.p["out_b"][0]
        return logit, (cache_f, cache_b, both, inner, weight, pooled)

    def backward(self, d_logit: np.ndarray, kept, shape: tuple[int, int]) -> tuple[dict, np.ndarray]:
        """Gradients of all but the inputs, and those of the projected inputs."""
        cache_f, cache_b, both, inner, weight, pooled = kept
        g = {"out": pooled.T @ d_logit, "out_b": np.array([d_logit.sum()], dtype=np.float32)}
        d_pooled = d_logit[:, None] * self.p["out"]
        d_weight = (both * d_pooled).sum(axis=2)
        d_both = weight[:, :, None] * d_pooled
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
        g["att_v"] = np.einsum("tn,tna->a", d_score, inner)
        d_inner = d_score[:, :, None] * self.p["att_v"] * (1 - inner * inner)
        g["att"] = np.einsum("tnh,tna->ha", both, d_inner)
        d_both += d_inner @ self.p["att"].T
        n, steps = shape
        d_table = np.zeros((n, steps, 6 * HIDDEN), dtype=np.float32)
        for d, cache, part in (("f", cache_f, d_both[:, :, :HIDDEN]), ("b", cache_b, d_both[:, :, HIDDEN:])):
            rec = self.p[f"rec_{d}"]
            g[f"rec_{d}"], dh = np.zeros_like(rec), np.zeros((n, HIDDEN), dtype=np.float32)
            a = 0 if d == "f" else 3 * HIDDEN
            for t, m, before, r, z, new, said in reversed(cache):
                out = dh[:m] + part[t, :m]
                d_new = out * (1 - z) * (1 - new * new)
                d_z = out * (before - new) * z * (1 - z)
                d_r = d_new * said * r * (1 - r)
                d_said = np.concatenate([d_r, d_z, d_new * r], axis=1)
                d_table[:m, t, a : a + 3 * HIDDEN] = np.concatenate([d_r, d_z, d_new], axis=1)
                g[f"rec_{d}"] += before.T @ d_said
                dh[:m] = out * z + d_said @ rec.T
        return g, d_table


class Texts:
    """Texts as numbers of distinct words, cut into windows."""

    def __init__(self, network: Network):
        self.network = network
        self.forget()

    def forget(self) -> None:
        self.numbers = Numbers()
        self.table = np.zeros((0, 6 * HIDDEN), dtype=np.float32)

    def numbered(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.numbers) > KEPT_WORDS:
            self.forget()
        out = []
        for t in texts:
            w = words(t)
            out.append(np.fromiter(map(self.numbers.__getitem__, w), dtype=np.int32, count=len(w)))
        return out

    def learn(self) -> None:
        """Inputs of the words numbered since."""
        new = self.numbers.taken()
        if new:
            self.table = np.concatenate([self.table, self.network.projected(self.network.inputs(*features(new)))])


def cut(numbered: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, words) of all windows; the last one of a text may be short."""
    size = np.array([len(x) for x in numbered], dtype=np.int64)
    n = np.where(size > 0, 1 + np.maximum(0, -(-(size - WINDOW) // STRIDE)), 0)
    text = np.repeat(np.arange(len(numbered)), n)
    first = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * STRIDE
    return text, first, np.minimum(WINDOW, size[text] - first)


def windows_of(numbered: list[np.ndarray], text: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, index, length) of the windows, longest first; short ones are filled up with number 0."""
    flat = np.concatenate(numbered) if numbered else np.zeros(0, dtype=np.int32)
    size = np.array([len(x) for x in numbered], dtype=np.int64)
    start = (np.cumsum(size) - size)[text] + first
    order = np.argsort(-length, kind="stable")
    steps = np.arange(int(length.max(initial=1)))
    at = start[order][:, None] + steps
    inside = steps < length[order][:, None]
    return order, np.where(inside, flat[np.minimum(at, len(flat) - 1)], 0), length[order]


def text_scores(network: Network, texts: Texts, batch: list[str]) -> np.ndarray:
    """The worst window's score of each text; 0 for texts without words."""
    numbered = texts.numbered(batch)
    texts.learn()
    text, first, length = cut(numbered)
    worst = np.full(len(batch), -np.inf)
    for a in range(0, len(text), WINDOWS_AT_ONCE):
        part = slice(a, a + WINDOWS_AT_ONCE)
        low, high = int(text[part][0]), int(text[part][-1]) + 1
        order, index, size = windows_of(numbered[low:high], text[part] - low, first[part], length[part])
        logit, _ = network.forward(texts.table, index, size)
        np.maximum.at(worst, text[part][order], logit)
    return sigmoid(worst)


def fit(texts: list[str], labels: np.ndarray, seed: int = 7) -> Network:
    """Train on whole texts with labels 0 and 1."""
    rng = np.random.default_rng(seed)
    net, numbers = Network(seed), Numbers()
    numbered = [np.array([numbers[w] for w in words(t)], dtype=np.int32) for t in texts]
    own, runs, count = features(numbers.taken())
    first_run = np.cumsum(count) - count
    text, first, length = cut(numbered)
    y = labels.astype(np.float32)
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    epochs = max(5, -(-STEPS // -(-2 * len(texts) // BATCH)))
    for epoch in range(epochs):
        shuffled = rng.permutation(len(text))
        _, at = np.unique(text[shuffled], return_index=True)
        random = shuffled[at]
        if epoch < WARM_UP * epochs:
            more = rng.permutation(len(text))
            _, at = np.unique(text[more], return_index=True)
            chosen = np.concatenate([random, more[at]])
        else:
            table = net.projected(net.inputs(own, runs, count))
            logit = np.empty(len(text), dtype=np.float32)
            for a in range(0, len(text), WINDOWS_AT_ONCE):
                part = np.arange(a, min(len(text), a + WINDOWS_AT_ONCE))
                order, index, size = windows_of(numbered, text[part], first[part], length[part])
                logit[part[order]] = net.forward(table, index, size)[0]
            ranked = np.lexsort((-logit, text))
            _, at = np.unique(text[ranked], return_index=True)
            chosen = np.concatenate([ranked[at], random[y[text[random]] == 0]])
        rng.shuffle(chosen)
        rate = RATE * (1 - 0.8 * epoch / epochs)
        for a in range(0, len(chosen), BATCH):
            part = chosen[a : a + BATCH]
            order, index, size = windows_of(numbered, text[part], first[part], length[part])
            used, inverse = np.unique(index, return_inverse=True)
            # The character runs of the words in this batch.
            flat = np.repeat(first_run[used] - (np.cumsum(count[used]) - count[used]), count[used]) + np.arange(count[used].sum())
            x = net.inputs(own[used], runs[flat], count[used])
            # Half of the words show their characters only, so that these learn to speak for words never seen.
            shown = (rng.random((len(used), 1)) < 0.5).astype(np.float32)
            x[:, :DIM] *= shown
            logit, kept = net.forward(net.projected(x), inverse.reshape(index.shape), size, keep=True)
            d_logit = (sigmoid(logit) - y[text[part[order]]]) / np.float32(len(part))
            g, d_table = net.backward(d_logit, kept, index.shape)
            d_rows = np.zeros((len(used), 6 * HIDDEN), dtype=np.float32)
            np.add.at(d_rows, inverse.ravel(), d_table.reshape(-1, 6 * HIDDEN))
            d_x = np.zeros_like(x)
            for d, cols in (("f", slice(0, 3 * HIDDEN)), ("b", slice(3 * HIDDEN, None))):
                g[f"in_{d}"], g[f"bias_{d}"] = x.T @ d_rows[:, cols], d_rows[:, cols].sum(axis=0)
                d_x += d_rows[:, cols] @ net.p[f"in_{d}"].T
            g["word"], g["char"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["char"])
            np.add.at(g["word"], own[used], d_x[:, :DIM] * shown)
            np.add.at(g["char"], runs[flat], np.repeat(d_x[:, DIM:] / np.sqrt(count[used])[:, None].astype(np.float32), count[used], axis=0))
            step += 1
            for k, grad in g.items():
                mean, square = state[k]
                mean += 0.1 * (grad - mean)
                square += 0.01 * (grad * grad - square)
                net.p[k] -= (rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def train(docs: DataFrame, labels: DataFrame, *, sample_docs: int = SAMPLE_DOCS) -> Network | float:
    """Learn from labelled documents; without both classes, the share of toxic ones (0 without labels)."""
    marked = labels.select(F.col("doc_id").alias("id_"), F.col("toxic").cast("int").alias("toxic")).filter("id_ IS NOT NULL AND toxic IN (0, 1)")
    found = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    if len(found) < 2:
        return float(min(found, default=0))
    share = F.when(F.col("toxic") == 1, F.lit(sample_docs / found[1])).otherwise(F.lit(sample_docs / found[0]))
    chosen = marked.filter(F.pmod(F.xxhash64("id_"), F.lit(1 << 30)) < share * float(1 << 30)).distinct()
    # Some 2 * sample_docs ids by their shares, and never over twice that: a proven bound for the broadcast.
    ids = F.broadcast(chosen.limit(4 * sample_docs))
    rows = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("id_")).select("toxic", "text")
    # What the driver gets is bounded in rows and in characters.
    short = (F.length("text") <= 16 * SAMPLE_WORDS) & (F.size(F.split("text", " ")) <= SAMPLE_WORDS)
    rows = rows.filter(short).limit(4 * sample_docs).toPandas()
    rows = rows.loc[np.array([bool(words(t)) for t in rows["text"]], dtype=bool)].sort_values(["toxic", "text"])
    if rows["toxic"].nunique() < 2:
        return float(rows["toxic"].max()) if len(rows) else 0.0
    return fit(rows["text"].tolist(), rows["toxic"].to_numpy())


KEPT: dict[str, Texts] = {}


def kept_texts(network: Network) -> Texts:
    """The worker's word inputs under a network; only those of the last one are kept."""
    if network.key not in KEPT:
        KEPT.clear()
        KEPT[network.key] = Texts(network)
    return KEPT[network.key]


def score(docs: DataFrame, network: Network | float) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row; texts that are NULL or without words score 0."""
    shared = docs.sparkSession.sparkContext.broadcast(network)
    own = docs.select("doc_id", "text", (remainder("doc_id", 5) == 0).alias("held_out"))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        texts = None if isinstance(net, float) else kept_texts(net)
        for batch in batches:
            for row, part in slices(batch.column(1), 1 << 20):
                value = np.full(len(part), net) if texts is None else text_scores(texts.network, texts, part)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, len(part)), batch.column(2).slice(row, len(part)), pa.array(value, pa.float64()), pa.array((value >= 0.5).astype(np.int32))],
                    names=["doc_id", "held_out", "score", "predicted"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(rate, f"doc_id {kind}, held_out boolean, score double, predicted int")


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the labels of documents that are not held out, score all."""
    return score(docs, train(docs, labels.filter(remainder("doc_id", 5) != 0)))
