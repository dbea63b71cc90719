"""Toxic spans by a linear-chain conditional random field, and document scores.

Two labels per token, clean and toxic. A token's features are its form, its
first three to eight bytes, its last three and four, its shape and the forms to
its left and right, hashed into one table of weights; to these come weights for
the labels at the start and for the four transitions. The weights are fitted
by gradient ascent on the conditional likelihood of labelled tokens. As the
corpus labels documents only, tokens of toxic documents are labelled first:
those whose form, beginning or end is in far more toxic documents than chance
would put there.
The field fitted on these then labels the tokens of the toxic documents itself
and is fitted once more; all tokens of clean documents are clean, whatever
their form. Exact forward-backward marginals of every token of a text are
added up to its expected toxic tokens. How much better these fit the rate of
toxic documents than that of others goes through a logistic curve fitted on the
documents' labels. Runs of tokens whose marginal reaches one half are the
offending spans, as code point offsets in the text as it stands.

The fit uses a bounded sample of the labelled rows, at most `max_rows` rows and
`max_chars` characters, picked by a hash of the key (documented bounds; every
row is used while they aren't reached). The field itself is fitted on the
sample's toxic documents and `CLEAN_SHARE` times as many clean ones, the curve on
all of the sample. In counting forms, texts that share their first, middle or
last six tokens with an earlier text of the sample count once with it, as near
copies would count one author's words again and again.

All texts are scored whole. Emissions and marginals cost 16 bytes a token, the
recursions run over blocks, a bounded number at a time.

Null and empty texts have no tokens and get the score of an empty text. A
label that is null or belongs to no document isn't learned from. A key that
occurs several times is learned from with all its texts. Repeated rows get
equal rows; other columns are not read. An empty table gives an empty result.
Without any toxic training rows the score is the same low number for all.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelode.llm.common import documents, small_batches, table
from pagelode.llm.langid import held_out
from pagelode.llm.shingles import Words, mixed

MAX_ROWS = 4_000
MAX_CHARS = 12_000_000
CLEAN_SHARE = 2
THRESHOLD = 0.7
EPOCHS = 6
BATCH_TOKENS = 1 << 14
BLOCK = 64
CHUNK_TOKENS = 1 << 16
LIMIT = 5.0
SLOTS = 1 << 18
PREFIXES = (3, 4, 5, 6, 7, 8)
SUFFIXES = (3, 4)
# a feature marks tokens as toxic where it is in RATIO times as many toxic texts as expected, which chance alone would bring about no more often than CHANCE
CHANCE = 1e-5
RATIO = 4
TOKENS = re.compile(r"[^\W_]+")


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all tokens of all texts end to end the slots of their own features, slots 0 being none,
    a hash of their form, and the number of tokens of each text."""
    found = [TOKENS.findall(t) for t in texts]
    counts = np.array([len(f) for f in found], dtype=np.int64)
    data = "\n".join([" ".join(f) for f in found if f]).lower().encode()  # no lower case letter is a space
    data, start, end, _ = Words.split(data)
    forms = Words.hashes(data, start, end)
    sizes = end - start
    padded = bytes(8) + data + bytes(8)
    lanes = np.ndarray((len(data) + 8,), "<u8", padded, strides=(1,))
    out = np.zeros((len(start), 2 + len(PREFIXES) + len(SUFFIXES)), dtype=np.int32)

    def slot(values: np.ndarray, kind: int) -> np.ndarray:
        return (mixed(values + np.uint64(kind * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) % np.uint64(SLOTS - 1)).astype(np.int32) + 1

    out[:, 0] = slot(forms, 1)
    ahead = lanes[start + 8]
    for k, n in enumerate(PREFIXES):
        out[:, 1 + k] = np.where(sizes > n, slot(ahead & np.uint64((1 << 8 * n) - 1 & 0xFFFFFFFFFFFFFFFF), 2 + n), 0)
    behind = lanes[end]
    for k, n in enumerate(SUFFIXES):
        out[:, 1 + len(PREFIXES) + k] = np.where(sizes > n, slot(behind >> np.uint64(64 - 8 * n), 12 + n), 0)
    first = (ahead & np.uint64(0xFF)).astype(np.int64)
    shape = np.minimum(sizes, 15) * 4 + (first < 0x3A) * 2 + (first >= 0x80)
    out[:, -1] = slot(shape.astype(np.uint64), 20)
    return out, forms, counts


class Chain:
    """A two-label linear chain over tokens with hashed features."""

    def __init__(self):
        self.own = np.zeros(SLOTS)  # for label 1, as all emissions are
        self.left, self.right = np.zeros(SLOTS), np.zeros(SLOTS)
        self.start = np.zeros(2)
        self.step = np.zeros((2, 2))

    def emissions(self, slots: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The log weight of label 1 of each token; first marks where a text starts."""
        out = np.zeros(len(slots))
        for k in range(slots.shape[1]):
            out += self.own[slots[:, k]]
        form, inner = slots[:, 0], ~first[1:]
        out[1:] += self.left[form[:-1]] * inner
        out[:-1] += self.right[form[1:]] * inner
        return out

    def _potentials(self, emit: np.ndarray, first: np.ndarray) -> np.ndarray:
        m = np.empty((len(emit), 2, 2))
        m[:] = np.exp(self.step)
        m[first] = np.exp(self.start)[None, None, :]
        m[:, :, 1] *= np.exp(np.clip(emit, -30, 30))[:, None]
        m /= m.sum((1, 2), keepdims=True)
        return m

    def _blocks(self, emit: np.ndarray, first: np.ndarray) -> np.ndarray:
        m = self._potentials(emit, first)
        pad = np.broadcast_to(np.eye(2), (-len(m) % BLOCK, 2, 2))
        return np.concatenate([m, pad]).reshape(-1, BLOCK, 2, 2)

    def marginals(self, emit: np.ndarray, first: np.ndarray, pairs: bool = False):
        """P(toxic) of each token of many texts laid end to end; with pairs also the sum over all
        tokens but the first of texts of the joint marginals with the token before.

        The tokens are cut into blocks. The product of 2 x 2 potentials of each block
        is made for many blocks at once, the blocks are chained one after the other,
        and then the blocks run forwards and backwards, many at once again.
        """
        n = len(emit)
        parts = [slice(at, at + CHUNK_TOKENS) for at in range(0, n, CHUNK_TOKENS)]
        products = []
        for part in parts:
            blocks = self._blocks(emit[part], first[part])
            product = blocks[:, 0]
            for i in range(1, BLOCK):
                product = product @ blocks[:, i]
                if i % 16 == 15:
                    product /= product.sum((1, 2), keepdims=True)
            products += product.reshape(-1, 4).tolist()
        into, outof = np.empty((len(products), 2)), np.empty((len(products), 2))
        a, b = 0.5, 0.5
        for k, (p, q, r, s) in enumerate(products):
            into[k] = a, b
            a, b = a * p + b * r, a * q + b * s
            a, b = a / (a + b), b / (a + b)
        a, b = 0.5, 0.5
        for k in range(len(products) - 1, -1, -1):
            outof[k] = a, b
            p, q, r, s = products[k]
            a, b = p * a + q * b, r * a + s * b
            a, b = a / (a + b), b / (a + b)
        toxic, joint, at, before = np.zeros(n), np.zeros((2, 2)), 0, np.full((1, 2), 0.5)
        for part in parts:
            blocks = self._blocks(emit[part], first[part])
            width, size = len(blocks), len(emit[part])
            forward, backward = into[at : at + width].copy(), outof[at : at + width].copy()
            at += width
            alpha, beta = np.empty((width, BLOCK, 2)), np.empty((width, BLOCK, 2))
            for i in range(BLOCK):
                forward = np.einsum("wi,wij->wj", forward, blocks[:, i])
                forward /= forward.sum(1, keepdims=True)
                alpha[:, i] = forward
            for i in range(BLOCK - 1, -1, -1):
                beta[:, i] = backward
                backward = np.einsum("wij,wj->wi", blocks[:, i], backward)
                backward /= backward.sum(1, keepdims=True)
            alpha, beta = alpha.reshape(-1, 2)[:size], beta.reshape(-1, 2)[:size]
            both = alpha * beta
            toxic[part] = both[:, 1] / both.sum(1)
            if pairs:
                each = np.concatenate([before, alpha[:-1]])[:, :, None] * blocks.reshape(-1, 2, 2)[:size] * beta[:, None, :]
                joint += (each / each.sum((1, 2), keepdims=True))[~first[part]].sum(0)
                before = alpha[-1:]
        return (toxic, joint) if pairs else toxic

    def fit(self, texts: list[np.ndarray], labels: list[np.ndarray], epochs: int = EPOCHS, rate: float = 0.5, ridge: float = 1e-3) -> None:
        """Gradient ascent with a step for each weight (Adagrad), some texts at a time."""
        tables = (self.own, self.left, self.right, self.step, self.start)
        history = [np.full(t.shape, 1e-4) for t in tables]
        order = np.arange(len(texts))
        rng = np.random.Generator(np.random.PCG64(5))
        for _ in range(epochs):
            rng.shuffle(order)
            held: list[int] = []
            size = 0
            for i in [*order.tolist(), -1]:
                if held and (i < 0 or size >= BATCH_TOKENS):
                    slots, y = np.concatenate([texts[j] for j in held]), np.concatenate([labels[j] for j in held])
                    first = np.zeros(len(y), bool)
                    first[np.cumsum([0, *[len(texts[j]) for j in held[:-1]]])] = True
                    toxic, joint = self.marginals(self.emissions(slots, first), first, pairs=True)
                    inner = np.flatnonzero(~first[1:])
                    gap = y - toxic
                    want = np.zeros((2, 2))
                    np.add.at(want, (y[inner].astype(int), y[inner + 1].astype(int)), 1)
                    form = slots[:, 0]
                    gradients = (
                        np.bincount(slots.ravel(), np.repeat(gap, slots.shape[1]), SLOTS),
                        np.bincount(form[inner], gap[inner + 1], SLOTS),
                        np.bincount(form[inner + 1], gap[inner], SLOTS),
                        want - joint,
                        np.array([(toxic - y)[first].sum(), (y - toxic)[first].sum()]),
                    )
                    for at, gradient, sums in zip(tables, gradients, history, strict=True):
                        gradient -= ridge * at
                        sums += gradient**2
                        at += rate * gradient / np.sqrt(sums)
                    self.own[0] = 0.0
                    held, size = [], 0
                if i >= 0 and len(texts[i]):
                    held.append(i)
                    size += len(texts[i])


class ToxicityModel:
    """The chain and the curve from a text's marginals to its score."""

    def __init__(self, chain: Chain | None, curve: np.ndarray, rates: tuple[float, float] = (1e-4, 1e-2)):
        self.chain, self.curve, self.rates = chain, curve, rates

    def evidence(self, toxic: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """For each text 1 and its evidence: the log ratio of two Poisson rates for its expected toxic tokens, within LIMIT."""
        total, high, low = self.expected(toxic, lengths), self.rates[1], self.rates[0]
        evidence = total * np.log(high / low) - lengths * (high - low)
        return np.stack([np.ones(len(lengths)), np.clip(evidence, -LIMIT, LIMIT)], 1)

    @staticmethod
    def expected(toxic: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        ends = np.cumsum(lengths)
        sums = np.concatenate([[0.0], np.cumsum(toxic)])
        return np.maximum(sums[ends] - sums[ends - lengths], 0)

    def marginals(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """P(toxic) of all tokens end to end, and the number of tokens of each text."""
        parts, lengths = [np.zeros(0)], np.zeros(len(texts), dtype=np.int64)
        held: list[int] = []
        size = 0
        for i in range(len(texts) + 1):
            if held and (i == len(texts) or size >= 1 << 19):
                slots, _, lengths[held] = features([texts[j] or "" for j in held])
                parts.append(self.chain.marginals(*self._inputs(slots, lengths[held])) if self.chain else np.zeros(len(slots)))
                held, size = [], 0
            if i < len(texts):
                held.append(i)
                size += len(texts[i] or "")
        return np.concatenate(parts), lengths

    def _inputs(self, slots: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = np.zeros(len(slots), bool)
        first[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
        return self.chain.emissions(slots, first), first

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, list[np.ndarray]]:
        toxic, lengths = self.marginals(texts)
        scores = 1 / (1 + np.exp(-np.clip(self.evidence(toxic, lengths) @ self.curve, -30, 30)))
        return scores, np.split(toxic, np.cumsum(lengths)[:-1]) if len(lengths) else []


def spans(text: str, toxic: np.ndarray) -> list[tuple[int, int]]:
    """Code point ranges of runs of tokens with a marginal of one half or more."""
    out: list[list[int]] = []
    last = -2
    if len(toxic) and toxic.max() >= 0.5:
        for i, (m, p) in enumerate(zip(TOKENS.finditer(text), toxic, strict=True)):
            if p >= 0.5:
                if last == i - 1:
                    out[-1][1] = m.end()
                else:
                    out.append([m.start(), m.end()])
                last = i
    return [(a, b) for a, b in out]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.diag([1e-3, *[1.0] * (x.shape[1] - 1)])
        w += np.linalg.solve(hessian, x.T @ (y - p) - ridge * np.array([1e-3, *[1.0] * (x.shape[1] - 1)]) * w)
    return w


class Excess:
    """Counts the texts that features (forms, beginnings and ends of tokens) occur in, to find those that toxic texts have in excess."""

    def __init__(self):
        self.seen: set = set()
        self.texts = np.zeros((2, SLOTS), dtype=np.int32)
        self.n = [0, 0]

    def add(self, own: np.ndarray, forms: np.ndarray, label: int) -> None:
        mid = len(forms) // 2
        keys = {hash(forms[:6].tobytes()), hash(forms[mid : mid + 6].tobytes()), hash(forms[-6:].tobytes())}
        if len(forms) and not keys & self.seen:
            self.seen |= keys
            self.n[label] += 1
            self.texts[label][np.unique(own[:, :-1])] += 1

    def found(self, chance: float = CHANCE, ratio: float = RATIO) -> np.ndarray:
        """Which features are in more toxic texts than their share of the other texts explains, by a Poisson tail."""
        mean = self.n[1] * (self.texts[0] + 1) / (self.n[0] + 1)
        out = np.zeros(SLOTS, bool)
        for slot in np.flatnonzero((self.texts[1] > ratio * mean) & (self.texts[1] > 1)).tolist():
            at, k = mean[slot], int(self.texts[1][slot])
            out[slot] = 1 - sum(math.exp(-at + i * math.log(at) - math.lgamma(i + 1)) for i in range(k)) < chance
        out[0] = False
        return out


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> ToxicityModel:
    """Fit on the texts of docs that labels marks, leaving out held-out rows."""
    spark = docs.sparkSession
    marked = labels.select(labels[key].alias("key"), labels[label].cast("int").alias("label")).filter("label is not null and key is not null").distinct()
    marked = marked.filter(~held_out(F.col("key")))
    texts = docs.select(docs[key].alias("key"), docs[text].alias("text")).filter("text is not null")
    sizes = texts.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    drawn = marked.join(sizes, "key").orderBy(F.xxhash64(F.lit(4), "key"), "key", "label").limit(max_rows).collect()
    kept, rows, chars = [], max_rows, max_chars
    for r in drawn:
        if r["n"] <= rows and r["chars"] <= chars:
            rows, chars = rows - r["n"], chars - r["chars"]
            kept.append((r["key"], r["label"]))
    got = texts.join(F.broadcast(spark.createDataFrame(kept, marked.schema)), "key").toArrow().to_pydict() if kept else {"text": [], "label": [], "key": []}
    order = sorted(range(len(got["key"])), key=lambda i: (got["key"][i], got["text"][i], got["label"][i]))
    samples, ys = [got["text"][i] for i in order], [int(got["label"][i] > 0) for i in order]
    clean = [i for i, y in enumerate(ys) if not y][: CLEAN_SHARE * sum(ys) + 100]
    chosen = sorted([i for i, y in enumerate(ys) if y] + clean)
    excess, slots = Excess(), dict.fromkeys(chosen)
    for at in range(0, len(samples), 64):
        own, forms, lengths = features(samples[at : at + 64])
        cuts = np.cumsum(lengths)[:-1]
        for i, (x, f) in enumerate(zip(np.split(own, cuts), np.split(forms, cuts), strict=True), at):
            excess.add(x, f, ys[i])
            if i in slots:
                slots[i] = x.copy()
    seeds = excess.found()
    texts_of = [slots[i] for i in chosen]
    targets = [seeds[x[:, :-1]].any(1).astype(float) * ys[i] for i, x in zip(chosen, texts_of, strict=True)]
    if not sum(t.sum() for t in targets):
        return ToxicityModel(None, np.array([-2.0, 0]))
    chain = Chain()
    chain.fit(texts_of, targets)
    model = ToxicityModel(chain, np.array([-2.0, 0]))
    for k, i in enumerate(chosen):
        if ys[i] and len(texts_of[k]):
            toxic = chain.marginals(*model._inputs(texts_of[k], np.array([len(texts_of[k])])))
            targets[k] = (toxic >= 0.5).astype(float)
    chain.fit(texts_of, targets)
    marginals, lengths = model.marginals(samples)
    truth = np.array(ys, float)
    total = model.expected(marginals, lengths)
    rate = [(total[truth == v].sum() + 0.5) / (lengths[truth == v].sum() + 1000) for v in (0, 1)]
    model.rates = (rate[0], max(rate[1], 2 * rate[0]))
    model.curve = logistic(model.evidence(marginals, lengths), truth)
    return model


def score_texts(df: DataFrame, model: ToxicityModel, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, offsets: bool = True) -> DataFrame:
    """key, score, predicted and, as asked for, spans (start, end in code points) of every row of df."""
    spark = df.sparkSession
    small_batches(spark)
    narrow = df.select(df[key].alias("key"), df[text].alias("text"))
    fields = [T.StructField(key, narrow.schema["key"].dataType), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    if offsets:
        fields.append(T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))))
    held = spark.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            scores, each = held.value.score(texts)
            columns = [batch.column(0), pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32))]
            if offsets:
                columns.append(pa.array([[{"start": a, "end": b} for a, b in spans(t or "", p)] for t, p in zip(texts, each, strict=True)], kind))
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    return narrow.mapInArrow(run, T.StructType(fields))


def drop_toxic(df: DataFrame, model: ToxicityModel, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of df whose text scores below threshold, with all their columns."""
    spark = df.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(model)
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, _ = held.value.score(batch.column(at).to_pylist())
            yield batch.filter(pa.array(scores < threshold))

    return df.mapInArrow(run, df.schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted and n_spans of every document."""
    docs = documents(spark, sf_dir)
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score_texts(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", F.size("spans").alias("n_spans"))
