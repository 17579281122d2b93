"""Toxicity by a convolutional text classifier that is trained in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import RangeHash, batched, dropped, frugal, saved, slices, word_hashes

BUCKETS, WIDTHS = 1 << 16, (1, 2, 3)  # a bucket is a 16-bit number
PAD = max(WIDTHS) - 1
LOWER = np.frombuffer(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)), dtype=np.uint8)
BREAK = np.array([not (48 <= c <= 57 or 97 <= c <= 122 or c >= 128) for c in range(256)])
HASH = RangeHash(20)
#: Bytes of a word that its features cover: the whole word and two beginnings.
REACH = (1 << 30, 4, 6)


def features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features (words, 3) of texts laid end to end, and the bounds of the texts in words."""
    starts, _, found = word_hashes(HASH, LOWER[data], bounds, BREAK, REACH)
    rows = np.stack([((f ^ np.uint64(k)) % np.uint64(BUCKETS)).astype(np.uint16) for k, f in enumerate(found)], axis=1)
    return rows, np.searchsorted(starts, bounds)


@dataclass
class TextCnn:
    embedding: np.ndarray  # buckets x size
    filters: list[np.ndarray]  # for each width: width x size x filters
    offsets: list[np.ndarray]
    dense: np.ndarray
    bias: float

    @classmethod
    def start(cls, docs: list[np.ndarray], labels: np.ndarray, size: int = 12, filters: int = 8, seed: int = 7) -> "TextCnn":
        """Random weights; one coordinate of an embedding starts at its bucket's smoothed log-odds."""
        rng = np.random.default_rng(seed)
        seen = np.zeros((2, BUCKETS))
        for ids, y in zip(docs, labels, strict=True):
            seen[int(y), np.unique(ids)] += 1
        n = np.maximum(1, np.bincount(labels.astype(int), minlength=2))
        odds = np.log((seen[1] + 0.2) / (n[1] + 1)) - np.log((seen[0] + 0.2) / (n[0] + 1))
        embedding = rng.normal(0, 0.05, (BUCKETS, size)).astype(np.float32)
        embedding[:, 0] = odds * seen.sum(axis=0) / (seen.sum(axis=0) + 4) / 4
        weights = [rng.normal(0, 0.15, (w, size, filters)).astype(np.float32) for w in WIDTHS]
        for w in weights:
            w[:, 0, : filters // 2] = 1.0 / len(w)
        dense = rng.normal(0.2, 0.1, filters * len(WIDTHS)).astype(np.float32)
        return cls(embedding, weights, [np.zeros(filters, dtype=np.float32) for _ in WIDTHS], dense, -2.0)

    def embedded(self, ids: np.ndarray) -> np.ndarray:
        out = self.embedding[ids[:, 0]]
        for k in range(1, ids.shape[1]):
            out += self.embedding[ids[:, k]]
        return out / ids.shape[1]

    def responses(self, rows: np.ndarray) -> list[np.ndarray]:
        """For each width the filters' responses at each row that has ``PAD`` rows after it."""
        n = len(rows) - PAD
        out = []
        for w, offset in zip(self.filters, self.offsets, strict=True):
            r = rows[:n] @ w[0]
            for k in range(1, len(w)):
                r += rows[k : k + n] @ w[k]
            out.append(r + offset)
        return out

    def laid_out(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Embedded texts one after another, each with ``PAD`` zero rows after it; an empty one is a zero row.

        Gives the rows, each word's row, and the first row and number of window starts of each text.
        """
        n = np.maximum(lengths, 1)
        first = np.concatenate([[0], np.cumsum(n + PAD)])
        place = np.arange(len(ids)) + np.repeat(first[:-1] - (np.cumsum(lengths) - lengths), lengths)
        rows = np.zeros((first[-1], self.embedding.shape[1]), dtype=np.float32)
        rows[place] = self.embedded(ids)
        return rows, place, first[:-1], n

    def pooled(self, ids: np.ndarray, bounds: np.ndarray, block: int = 1 << 17) -> np.ndarray:
        """Maximum responses of each text, all windows counted; memory is bounded by ``block`` words."""
        n, out = len(bounds) - 1, []
        k = 0
        while k < n:
            end = k + 1
            while end < n and bounds[end + 1] - bounds[k] <= block:
                end += 1
            a, b = int(bounds[k]), int(bounds[end])
            if end > k + 1 or b - a <= block:
                rows, _, first, starts = self.laid_out(ids[a:b], np.diff(bounds[k : end + 1]))
                # maxima of every other stretch: a text's window starts, then its padding
                cuts = np.stack([first, first + starts], axis=1).ravel()[:-1]
                out.append(np.concatenate([np.maximum.reduceat(r, cuts, axis=0)[::2] for r in self.responses(rows)], axis=1))
            else:
                best = []
                for at in range(a, b, block):  # one long text, in blocks whose windows reach into the next
                    to = min(b, at + block)
                    rows = np.zeros((to - at + PAD, self.embedding.shape[1]), dtype=np.float32)
                    reach = ids[at : min(b, to + PAD)]
                    rows[: len(reach)] = self.embedded(reach)
                    best.append(np.concatenate([r.max(axis=0) for r in self.responses(rows)]))
                out.append(np.max(best, axis=0)[None])
            k = end
        return np.concatenate(out) if out else np.zeros((0, len(self.dense)), dtype=np.float32)

    def scores(self, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        z = np.maximum(self.pooled(ids, bounds), 0) @ self.dense + self.bias
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))

    def train(self, docs: list[np.ndarray], labels: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.02, seed: int = 11) -> None:
        """Adam on the logistic loss; through a maximum only the window that gave it learns."""
        rng = np.random.default_rng(seed)
        weights = [self.embedding, *self.filters, *self.offsets, self.dense]
        first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
        weight = min(5.0, max(1.0, float((labels == 0).sum() / max(1, (labels == 1).sum())) ** 0.5))
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(docs))
            for begin in range(0, len(order), batch):
                chosen = order[begin : begin + batch]
                ids = np.concatenate([docs[i] for i in chosen])
                rows, place, first_row, starts = self.laid_out(ids, np.array([len(docs[i]) for i in chosen]))
                at, values = [], []
                for r in self.responses(rows):
                    a = np.stack([r[f : f + n].argmax(axis=0) + f for f, n in zip(first_row, starts, strict=True)])
                    at.append(a)
                    values.append(np.take_along_axis(r, a, axis=0))
                pooled = np.maximum(np.concatenate(values, axis=1), 0)
                y = labels[chosen]
                p = 1 / (1 + np.exp(-np.clip(pooled @ self.dense + self.bias, -30, 30)))
                dz = ((p - y) * np.where(y == 1, weight, 1.0) / len(chosen)).astype(np.float32)
                d_pooled = dz[:, None] * self.dense * (pooled > 0)
                d_rows, grads, k = np.zeros_like(rows), [], 0
                d_offsets = []
                for w, a in zip(self.filters, at, strict=True):
                    d = d_pooled[:, k : k + w.shape[2]]
                    k += w.shape[2]
                    g = np.zeros_like(w)
                    for o in range(len(w)):
                        g[o] = np.einsum("df,dfs->sf", d, rows[a + o])
                        np.add.at(d_rows, a + o, d[:, :, None] * w[o].T[None])
                    grads.append(g)
                    d_offsets.append(d.sum(axis=0))
                touched = np.flatnonzero(np.abs(d_rows[place]).sum(axis=1))
                d_embedding = np.zeros_like(self.embedding)
                for c in range(ids.shape[1]):
                    np.add.at(d_embedding, ids[touched, c], d_rows[place[touched]] / ids.shape[1])
                step += 1
                for w, g, m, v in zip(weights, [d_embedding, *grads, *d_offsets, pooled.T @ dz], first, second, strict=True):
                    m *= 0.9
                    m += 0.1 * g
                    v *= 0.999
                    v += 0.001 * g * g
                    w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
                self.bias -= rate * float(dz.sum())


@dataclass
class ToxicityModel:
    network: TextCnn | None
    thresholds: dict[str, float]
    threshold: float

    def scores(self, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return np.zeros(len(bounds) - 1) if self.network is None else self.network.scores(ids, bounds)


def best_threshold(scores: np.ndarray, labels: np.ndarray, default: float = 0.5) -> float:
    """The threshold with the best F1, in the middle of the gap that gives it."""
    minus, at = np.unique(-scores, return_inverse=True)
    return best_cut(-minus, -minus, np.bincount(at), np.bincount(at, labels), default)


def best_cut(least: np.ndarray, most: np.ndarray, rows: np.ndarray, toxic: np.ndarray, default: float = 0.5) -> float:
    """The best F1's threshold between bins of falling score, of which all or no rows are flagged."""
    if toxic.sum() == 0 or toxic.sum() == rows.sum():
        return default
    k = int(np.argmax(2 * np.cumsum(toxic) / (np.cumsum(rows) + toxic.sum())))
    return float((least[k] + (most[k + 1] if k + 1 < len(most) else 0.0)) / 2)


def fold(column: str):
    """crc32 of the id as text, modulo 5; 0 is held out."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5


def fit(
    docs: DataFrame, labels: DataFrame, max_rows: int = 12_000, max_words: int = 16 << 20,
    id_column: str = "doc_id", text_column: str = "text", language: str = "lang",
) -> ToxicityModel:
    """Train on at most ``max_rows`` labelled rows of at most ``max_words`` words in all, whole texts.

    They are the first by a hash of their ids; the first that would exceed the words ends them, but
    for the very first.  Six bytes a word come to the driver, so both bound its memory.
    Rows of fold 0 are never used.  Fold 1 does not train the network: all its labelled rows calibrate
    a threshold for each language that has both labels there, and one over all for the others.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col(id_column).isNotNull() & (fold(id_column) != 0))
    known = known.groupBy(id_column).agg(F.max(F.col("toxic").cast("int")).alias("_toxic"))
    held = known.where(fold(id_column) == 1)
    known = known.where(fold(id_column) != 1).orderBy(F.xxhash64(id_column), id_column).limit(max_rows)
    tongue = F.col(language) if language in docs.columns else F.lit(None)
    rows = batched(docs).select(id_column, F.col(text_column).alias("_text"), tongue.cast("string").alias("_lang"))
    order = F.xxhash64(F.col(id_column), F.col(id_column).cast("string")).alias("_order")
    labelled = rows.join(F.broadcast(known), id_column).select("_text", "_toxic", order)

    def hashed(batches):
        for batch in batches:
            for data, bounds, a, b in slices(batch.column(0)):
                ids, bounds = features(data, bounds)
                values = pa.ListArray.from_arrays(pa.array((bounds * ids.shape[1]).astype(np.int32)), pa.array(ids.ravel().view(np.int16)))
                yield pa.RecordBatch.from_arrays([values, *(c.slice(a, b - a) for c in batch.columns[1:])], ["ids", "toxic", "place"])

    words = saved(labelled.mapInArrow(frugal(hashed), "ids array<short>, toxic int, place long"), "toxicity-words")
    sizes = words.select("place", "toxic", (F.size("ids") / len(REACH)).cast("long").alias("n"))
    # one task, over ``max_rows`` sizes at most
    before = Window.partitionBy(F.lit(0)).orderBy("place", "n", "toxic").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first, end = sizes.withColumn("all", F.sum("n").over(before)).agg(F.min("place"), F.min(F.when(F.col("all") > max_words, F.col("place")))).first()
    chosen = words if end is None else words.where((F.col("place") < end) | (F.col("place") == first))
    got = chosen.select("ids", "toxic").toArrow().combine_chunks()
    dropped(words)
    y = got.column("toxic").to_numpy().astype(np.float32)
    texts = [x.values.to_numpy().view(np.uint16).reshape(-1, len(REACH)) for x in got.column("ids")]
    # rows come in any order: fix one, so that equal tables give equal models
    train = sorted(range(len(y)), key=lambda k: (y[k], len(texts[k]), texts[k].tobytes()))
    if len({float(y[k]) for k in train}) < 2:
        return ToxicityModel(None, {}, 0.5)
    network = TextCnn.start([texts[k] for k in train], y[train])
    network.train([texts[k] for k in train], y[train])
    by, over_all = calibrated(rows.where(fold(id_column) == 1), held, network, id_column)
    return ToxicityModel(network, by, over_all)


BINS = 64  # score bins for each unit of the logit


def calibrated(rows: DataFrame, held: DataFrame, network: TextCnn, id_column: str) -> tuple[dict[str, float], float]:
    """Thresholds by language, and over all, from every row (id, _text, _lang) that ``held`` labels.

    Texts are scored where they lie, and only scores meet the labels.  The driver gets counts by
    language, label and bin of the score: at most 60 * BINS + 1 bins, whatever the corpus.
    """
    shared = rows.sparkSession.sparkContext.broadcast(ToxicityModel(network, {}, 0.5))

    def apply(batches):
        for batch in batches:
            s, _ = verdicts(shared.value, batch.column(1), batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(s)], ["id", "lang", "score"])

    kind = rows.schema[id_column].dataType.simpleString()
    scored = rows.mapInArrow(frugal(apply), f"id {kind}, lang string, score double").join(held.withColumnRenamed(id_column, "id"), "id")
    part = F.floor(F.log(F.col("score") / (1 - F.col("score"))) * BINS).alias("bin")
    counted = scored.groupBy("lang", part).agg(F.count("*").alias("n"), F.sum("_toxic").alias("toxic"), F.min("score").alias("least"), F.max("score").alias("most"))
    langs: dict = {}
    whole: dict = {}
    for r in counted.collect():
        langs.setdefault(r["lang"], []).append((r["least"], r["most"], r["n"], r["toxic"]))
        a = whole.get(r["bin"], (1.0, 0.0, 0, 0))
        whole[r["bin"]] = (min(a[0], r["least"]), max(a[1], r["most"]), a[2] + r["n"], a[3] + r["toxic"])
    cut = lambda bins: best_cut(*map(np.array, zip(*sorted(bins, reverse=True), strict=True)))
    both = lambda bins: 0 < sum(b[3] for b in bins) < sum(b[2] for b in bins)
    return {x: cut(bins) for x, bins in langs.items() if x is not None and both(bins)}, cut(whole.values()) if whole else 0.5


def score(docs: DataFrame, model: ToxicityModel, id_column: str = "doc_id", text_column: str = "text", language: str = "lang") -> DataFrame:
    """Rows (id, held_out, score, predicted, threshold, flagged), one for each input row, whole texts.

    ``score`` depends on the text alone; ``flagged`` compares it with the language's threshold, or
    with the general one where the language is null or was not calibrated.  A null or empty text
    has the score of no word at all.  Null ids are not held out.  Equal rows stay apart, an empty
    table gives no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches):
        for batch in batches:
            s, limits = verdicts(shared.value, batch.column(1), batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array(limits)], ["id", "score", "threshold"])

    tongue = F.col(language) if language in docs.columns else F.lit(None)
    kind = docs.schema[id_column].dataType.simpleString()
    rows = batched(docs).select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), tongue.cast("string").alias("lang"))
    scored = rows.mapInArrow(frugal(apply), f"id {kind}, score double, threshold double")
    return scored.select(
        F.col("id").alias(id_column), F.coalesce(fold("id") == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "threshold", (F.col("score") >= F.col("threshold")).alias("flagged"),
    )


def verdicts(model: ToxicityModel, texts: pa.Array, languages: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    scores = [model.scores(*features(data, bounds)) for data, bounds, *_ in slices(texts)]
    limits = [model.thresholds.get(x, model.threshold) for x in languages.to_pylist()]
    return np.concatenate([np.zeros(0), *scores]), np.array(limits, dtype=np.float64)


def without_toxic(docs: DataFrame, model: ToxicityModel, text_column: str = "text", language: str = "lang") -> DataFrame:
    """The rows of ``docs``, all columns, that are not flagged; one narrow pass."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_column)
    spoken = docs.columns.index(language) if language in docs.columns else None

    def keep(batches):
        for batch in batches:
            languages = pa.nulls(batch.num_rows, pa.string()) if spoken is None else batch.column(spoken)
            s, limits = verdicts(shared.value, batch.column(at), languages)
            yield batch.filter(pa.array(s < limits))

    return batched(docs).mapInArrow(frugal(keep), docs.schema)
