"""Toxicity by a small convolutional text classifier, trained in numpy.

Words (runs of letters and digits, A-Z lower-cased) and their first four and five bytes are
looked up by hash in embedding tables; filters of several widths run over the text, are
max-pooled and feed one logistic unit.  Embeddings start at the entry's weighted log-odds in
the fitted rows and a small random coordinate, and are trained by gradient together with the
filters and the unit, in numpy over batches of texts laid end to end.  Thresholds are
calibrated by language on rows kept from the fit: the score is shifted so that 0.5 is the
language's threshold.  The language is
guessed from the text itself; no column but the text enters a score.
"""

from __future__ import annotations

import pickle
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extended, mix, short_batches, word_hashes

WIDTHS = (1, 2, 3)
FILTERS = 6
#: Bytes of a word that each embedding table is keyed by (None: all), and coordinates of each.
PREFIXES = (None, 4, 5)
PART = 2
DIM = PART * len(PREFIXES)
#: Step of the embeddings.
RATE = 0.005
#: Letters that tell the languages apart, as UTF-8; a text without them is "en".
LANGUAGES = {"de": "ßäüö", "es": "ñóáíú¿¡", "fr": "çèêàùâîô"}
_MARKS = {k: [c.encode() for c in v] for k, v in LANGUAGES.items()}


def language(raw: bytes) -> str:
    """The language whose letters occur most; "en" if none does."""
    counts = {k: sum(map(raw.count, v)) for k, v in _MARKS.items()}
    best = max(sorted(counts), key=counts.get)
    return best if counts[best] * 200 > len(raw) else "en"


def hashes(raw: bytes) -> np.ndarray:
    """(tables, words) hashes of a text."""
    return np.stack([word_hashes(raw, lower=True, letters=True, prefix=p) for p in PREFIXES])


#: Empty words before and after each text, so that no filter spans two texts.
PAD = max(WIDTHS) - 1
#: Words of texts that are convolved together.
TOGETHER = 1 << 15


@dataclass
class Flat:
    """Rows of several texts laid one behind the other."""

    rows: np.ndarray  # (tables, places)
    starts: np.ndarray
    owner: np.ndarray

    @classmethod
    def of(cls, texts: list[np.ndarray]) -> Flat:
        sizes = np.array([t.shape[1] + 2 * PAD for t in texts])
        starts = np.cumsum(sizes) - sizes
        rows = np.zeros((len(PREFIXES), int(sizes.sum())), np.int64)
        for t, at in zip(texts, starts.tolist(), strict=True):
            rows[:, at + PAD : at + PAD + t.shape[1]] = t
        return cls(rows, starts, np.repeat(np.arange(len(texts)), sizes))


def _flats(texts: list[np.ndarray]):
    """The texts in runs of TOGETHER words or one text."""
    at = 0
    while at < len(texts):
        n, end = 0, at
        while end < len(texts) and (end == at or n + texts[end].shape[1] <= TOGETHER):
            n += texts[end].shape[1]
            end += 1
        yield Flat.of(texts[at:end])
        at = end


@dataclass
class Model:
    keys: list[np.ndarray]  # of each table: sorted hashes; row i + 1 of words is that of keys[i], row 0 of all others
    words: list[np.ndarray]  # of each table: (rows, PART)
    filters: list[np.ndarray]  # (width, DIM, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    shift: dict[str, float]

    def rows(self, found: np.ndarray) -> np.ndarray:
        out = np.zeros(found.shape, np.int32)
        for keys, own, into in zip(self.keys, found, out, strict=True):
            if len(keys) and len(own):
                at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                into[:] = np.where(keys[at] == own, at + 1, 0)
        return out

    def kernel(self) -> np.ndarray:
        """All filters' positions side by side: (DIM, positions * FILTERS)."""
        return np.concatenate([w[j] for w in self.filters for j in range(len(w))], axis=1)

    def pooled(self, flat: Flat, part: np.ndarray, places: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
        """Max-pooled responses of each text, and where asked the places they come from.

        part has the response of every place to every position of every filter.
        """
        high, place, column = [], [], 0
        for w in self.filters:
            n = len(part) - len(w) + 1
            total = 0
            for j in range(len(w)):
                total = total + part[j : j + n, column : column + FILTERS]
                column += FILTERS
            high.append(np.maximum.reduceat(total, flat.starts, axis=0))
            if places:
                at = np.where(total == high[-1][flat.owner[:n]], np.arange(n)[:, None], n)
                place.append(np.minimum.reduceat(at, flat.starts, axis=0))
        return np.maximum(np.concatenate(high, axis=1) + self.bias, 0), place

    def table(self) -> list[np.ndarray]:
        """Responses of every table's entries to every position of every filter."""
        kernel = self.kernel()
        return [(words @ kernel[i * PART : (i + 1) * PART]).astype(np.float32) for i, words in enumerate(self.words)]

    def logits(self, texts: list[np.ndarray], table: list[np.ndarray]) -> np.ndarray:
        out = []
        for flat in _flats(texts):
            part = table[0][flat.rows[0]]
            for own, rows in zip(table[1:], flat.rows[1:], strict=True):
                part += own[rows]
            out.append(self.pooled(flat, part)[0] @ self.out + self.out_bias)
        return np.concatenate(out) if out else np.empty(0)


def _one_of_copies(texts: list[np.ndarray]) -> list[int]:
    """Places of texts without later near copies, by minima over their less common words.

    Copies would let a row see its own label by way of its twins, and one label count often.
    """
    seen = [np.unique(t[0]) for t in texts]
    words, counts = np.unique(np.concatenate([np.empty(0, np.uint64), *seen]), return_counts=True)
    common = words[counts > max(3, len(texts) // 20)]
    found: set[tuple] = set()
    out = []
    for i, own in enumerate(seen):
        rare = own[~np.isin(own, common)]
        rare = rare if len(rare) else own
        least = [int(mix(rare ^ np.uint64(s)).min()) if len(rare) else 0 for s in range(1, 7)]
        keys = {(k, *least[k : k + 2]) for k in (0, 2, 4)}
        if not keys & found:
            out.append(i)
        found |= keys
    return out


def train(texts: list[np.ndarray], toxic: np.ndarray, kept: np.ndarray, langs: list[str], seed: int = 5) -> Model:
    """Fit on the rows not kept, then calibrate thresholds on the kept ones; empties texts.

    Fewer than two classes among the fitted rows give a model that scores all texts alike.
    """
    rng = np.random.default_rng(seed)
    fit = np.array([i for i in _one_of_copies(texts) if not kept[i]], np.int64)
    positive = int(toxic[fit].sum())
    rate = (positive + 1) / (len(fit) + 2)
    filters = [rng.normal(0, 0.05, (w, DIM, FILTERS)) for w in WIDTHS]
    for w in filters:
        w[len(w) // 2, ::PART, : FILTERS // 2] = 0.5
    empty = [np.empty(0, np.uint64) for _ in PREFIXES], [np.zeros((1, PART)) for _ in PREFIXES]
    model = Model(*empty, filters, np.full(len(WIDTHS) * FILTERS, -1.0), np.zeros(len(WIDTHS) * FILTERS), float(np.log(rate / (1 - rate))), {})
    if positive in (0, len(fit)):
        return model
    # A fitted row sees the weights without its own count, or it would know its own label.
    without: list[list[np.ndarray]] = [[], []]

    def weight(t, n):
        odds = np.log((t + 0.5) / (positive + 1)) - np.log((n + 0.5) / (len(fit) - positive + 1))
        return np.concatenate([[0.0], odds / np.sqrt(1 / (t + 0.5) + 1 / (n + 0.5))])

    for i in range(len(PREFIXES)):
        seen = [np.unique(texts[x][i]) for x in fit]
        words, at = np.unique(np.concatenate(seen), return_inverse=True)
        owner = np.repeat(toxic[fit], [len(x) for x in seen])
        t, n = np.bincount(at, owner, len(words)), np.bincount(at, 1 - owner, len(words))
        common = t + n >= 3
        t, n = t[common], n[common]
        model.keys[i] = words[common]
        model.words[i] = np.column_stack([weight(t, n), np.concatenate([np.zeros((1, PART - 1)), rng.normal(0, 0.05, (len(t), PART - 1))])])
        for label, (tt, nn) in enumerate(((t, np.maximum(n - 1, 0)), (np.maximum(t - 1, 0), n))):
            without[label].append(np.column_stack([weight(tt, nn), model.words[i][:, 1:]]))
    # The hashes aren't needed any more; their rows take half the room.
    rows = []
    for i in range(len(texts)):
        rows.append(model.rows(texts[i]).astype(np.int32))
        texts[i] = None

    parameters = [*model.filters, model.bias, model.out]
    model.out[:] = rng.uniform(0.1, 0.3, len(model.out))
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in parameters]
    # Embeddings start at the log-odds and are trained by what is learned on top of them.
    base = [np.concatenate(both) for both in zip(*without, strict=True)]
    learned = [np.zeros_like(w) for w in model.words]
    seen = [np.full(w.shape, 1e-2) for w in model.words]
    passes = max(6, min(40, 40_000 // len(fit)))
    step = 0
    for _ in range(passes):
        for batch in np.array_split(rng.permutation(fit), max(1, len(fit) // 32)):
            flat = Flat.of([rows[i] for i in batch])
            label = toxic[batch]
            side = label[flat.owner]
            own = [own + side * len(new) for own, new in zip(flat.rows, learned, strict=True)]
            embedded = np.concatenate([b[o] + new[r] for b, o, new, r in zip(base, own, learned, flat.rows, strict=True)], axis=1)
            high, place = model.pooled(flat, embedded @ model.kernel(), places=True)
            error = 1 / (1 + np.exp(-np.clip(high @ model.out + model.out_bias, -500, 500))) - label
            back = error[:, None] * model.out * (high > 0)
            grads = [*(np.zeros_like(w) for w in model.filters), back.sum(axis=0), error @ high]
            moved = [np.zeros_like(w) for w in learned]
            for k, w in enumerate(model.filters):
                pull = back[:, k * FILTERS : (k + 1) * FILTERS]
                for j in range(len(w)):
                    at = place[k] + j
                    grads[k][j] += np.einsum("bfd,bf->df", embedded[at], pull)
                    for t, into in enumerate(moved):
                        np.add.at(into, flat.rows[t][at], pull[..., None] * w[j, t * PART : (t + 1) * PART].T)
            step += 1
            for p, g, (m, v) in zip(parameters, grads, moments, strict=True):
                g = g / len(batch) + 1e-4 * p
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            for new, g, total in zip(learned, moved, seen, strict=True):
                g[0] = 0
                g = g / len(batch) + 1e-5 * new
                total += g * g
                new -= RATE * g / np.sqrt(total)
            np.maximum(model.out, 0, out=model.out)  # a clean passage doesn't excuse a toxic one
            model.out_bias -= 0.05 * float(error.sum()) / len(batch)
    model.words = [w + new for w, new in zip(model.words, learned, strict=True)]

    logits = model.logits(rows, model.table())
    # Judged rows are kept ones where there are enough; else all, whose words are then known.
    judge = kept if kept.sum() >= 40 and toxic[kept].sum() >= 5 else np.ones(len(rows), bool)

    def threshold(which: np.ndarray, prior: float | None) -> float:
        """Of fewest errors, clean texts counting twice; ties nearest the prior or the widest gap."""
        order = np.sort(logits[which])
        cuts = np.concatenate([[order[0] - 1], (order[1:] + order[:-1]) / 2, [order[-1] + 1]])
        wrong = np.array([2 * ((logits > c) & which & (toxic == 0)).sum() + ((logits <= c) & which & (toxic == 1)).sum() for c in cuts])
        best = np.flatnonzero(wrong == wrong.min())
        gap = np.concatenate([[1], order[1:] - order[:-1], [1]])
        return float(cuts[best[np.argmax(gap[best])]] if prior is None else cuts[best[np.argmin(np.abs(cuts[best] - prior))]])

    overall = threshold(judge, None)
    names = np.array(langs)
    for lang in [*LANGUAGES, "en"]:
        own = judge & (names == lang)
        n = int(toxic[own].sum())
        model.shift[lang] = (n * threshold(own, overall) + 20 * overall) / (n + 20) if n else overall
    return model


def toxicity(
    docs: DataFrame, labels: DataFrame, training: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "toxic", most_rows: int = 5000,
) -> DataFrame:
    """Adds held_out, score (0 to 1) and predicted (1 if score >= 0.5) to every row of docs.

    labels has id_col and label_col; the model is fitted on at most `most_rows` labelled rows
    of training (docs if None), chosen by a hash, whose crc32(id as text) mod 5 is not 0, and
    scores every whole text.  Rows with a null label or id don't train; of repeated labels the
    greatest counts; no usable labels give a constant score of 0.  Null and empty texts are
    scored as empty, very long ones whole; a null id is not held out.  Repeated rows score
    alike.  Columns of the added names are replaced; empty docs: empty.
    """
    short_batches(docs.sparkSession)
    docs = docs.drop("held_out", "score", "predicted")
    training = docs if training is None else training

    def remainder(id_):
        return F.crc32(F.col(id_).cast("string").cast("binary")) % 5

    known = (
        labels.select(F.col(id_col).alias("_tx_id"), F.col(label_col).cast("int").alias("_tx_toxic")).dropna()
        .filter(remainder("_tx_id") != 0).groupBy("_tx_id").agg(F.max("_tx_toxic").alias("_tx_toxic"))
        .orderBy(F.xxhash64("_tx_id"), "_tx_id").limit(most_rows)
    )

    def hashed(batches):
        for batch in batches:
            raws = [x.as_py() or b"" for x in batch.column(2)]
            words = pa.array([hashes(r).tobytes() for r in raws], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), words, pa.array(map(language, raws), pa.string())], names=["id", "toxic", "words", "lang"])

    def fit(batches):
        fitted = [b for b in batches if b.num_rows]
        if not fitted:
            return
        fitted = pa.Table.from_batches(fitted).sort_by("id")
        kept = np.array([zlib.crc32(str(i).encode()) % 5 == 4 for i in fitted["id"].to_pylist()], bool)
        toxic, langs = fitted["toxic"].to_numpy(), fitted["lang"].to_pylist()
        texts = [np.frombuffer(w.as_py(), np.uint64).reshape(len(PREFIXES), -1) for w in fitted["words"]]
        del fitted
        pa.default_memory_pool().release_unused()
        model = pickle.dumps(train(texts, toxic, kept, langs))
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], names=["model"])

    # At most most_rows rows of two numbers: bounded by the parameter, so broadcast.  Of rows
    # that repeat an id the least text is fitted, so reruns agree.
    chosen = training.join(F.broadcast(known), training[id_col] == known["_tx_id"]).groupBy("_tx_id", "_tx_toxic").agg(F.min(F.col(text_col)).cast("binary").alias("_tx_text"))
    fitted = chosen.mapInArrow(hashed, f"id {dict(labels.dtypes)[id_col]}, toxic int, words binary, lang string")
    # One task fits these rows; only the model comes to the driver, never their words.
    models = fitted.repartition(1).mapInArrow(fit, "model binary").collect()
    model = pickle.loads(models[0]["model"]) if models else None
    # Words and filters: bounded by most_rows texts.
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        model = shared.value
        table = model.table() if model else None
        for batch in batches:
            raws = [x.as_py() or b"" for x in batch.column(batch.schema.names.index(text_col)).cast(pa.binary())]
            out = np.zeros(len(raws))
            if model and raws:
                shift = np.array([model.shift.get(language(r), 0.0) for r in raws])
                logits = model.logits([model.rows(hashes(r)) for r in raws], table) - shift
                out = 1 / (1 + np.exp(-np.clip(logits, -700, 700)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[*batch.schema.names, "score"])

    scored = docs.mapInArrow(score, extended(docs.schema, "score double"))
    return scored.select(
        *docs.columns,
        F.coalesce(remainder(id_col) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
