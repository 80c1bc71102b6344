"""Language identification by averaged hashed subword embeddings (operator 3).

A text is the mean of the embeddings of its byte n-grams (2 to 4 bytes of lower-cased letters, hashed to ``2**bits``
buckets; an n-gram may start or end at a word's edge but not span it). A linear softmax on the mean gives the languages and,
beside them, "none". Embeddings and softmax are trained together in numpy by stochastic gradient descent, one example at a
time, on at most ``sample`` labelled documents (whole texts, and random stretches of them so that short texts are known too).

What "none" looks like is made from the same texts (``foreign``): letters under a random substitution, which keeps the shape
of a language and changes its spelling; letters of other scripts; shuffled and random letters; repeated ones. A held-out
fifth, and foreign text made from it, sets a temperature and the rejection threshold: the smallest calibrated probability of
the known languages together from which on at most ``risk`` of the held-out pieces are foreign. A text is rejected below it,
or if "none" is likelier than all languages together; a text that mixes known languages isn't rejected for that.

Scale: since the softmax is linear in the mean, each bucket's logits are one row of a table of a megabyte, which is all
that the tasks get. Scoring is a map over the scan, vectorised over slices of texts, without a shuffle. The sample is the
rows with the smallest hashes of their id, found without a shuffle from the id and label columns; only its texts are read then.

Edge cases: a null text or one without letters is rejected with a null language and confidence 0; a null id is kept;
repeated rows get equal results; texts are read whole whatever their length; labels that are null are not trained on; ties
between languages go to the first in order; without any labelled text every document is rejected; an empty table gives an
empty result. ``keep_known`` passes all columns through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwork.llm import common

BITS = 15
DIM = 16
SAMPLE = 2000
EPOCHS = 4
RATE = 0.4
#: Share of foreign pieces among those accepted, at the most.
RISK = 0.01
#: Scripts, by their first and last letter, that foreign text is made of.
SCRIPTS = ((0x61, 0x7A), (0x3B1, 0x3C9), (0x430, 0x44F), (0x561, 0x587), (0x5D0, 0x5EA), (0x627, 0x64A), (0x905, 0x939), (0xE01, 0xE2E), (0x10D0, 0x10F0), (0x3041, 0x3096), (0x4E00, 0x5E00), (0xAC00, 0xAE00))
#: Stretches that each training text gives besides itself, and their least and most bytes.
STRETCHES, SHORT, LONG = 3, 12, 240
_LETTER = np.zeros(256, bool)
_LETTER[[*range(97, 123), *range(128, 256)]] = True


def grams(data: np.ndarray, at: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams, and for each its text."""
    n_texts = len(at) - 1
    out, owner = [], []
    letter = _LETTER[data]
    b = np.where(letter, data, 32).astype(np.uint32)
    text = np.repeat(np.arange(n_texts, dtype=np.int32), np.diff(at))
    for n in (2, 3, 4):
        m = len(b) - n + 1
        if m <= 0:
            continue
        v = np.zeros(m, np.uint32)
        ok = text[:m] == text[n - 1 :]
        for j in range(n):
            v |= b[j : m + j] << np.uint32(8 * j)
            if 0 < j < n - 1:
                ok &= letter[j : m + j]
        ok &= letter[:m] | letter[n - 1 :]
        v = v[ok] + np.uint32(n * 0x01010101)
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x9E3779B1)
        out.append(v >> np.uint32(32 - bits))
        owner.append(text[:m][ok])
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    return np.concatenate(out).astype(np.int64), np.concatenate(owner)


def foreign(text: str, kind: int, rng: np.random.Generator) -> str:
    """A text of no language that is known, made of ``text``; there are six kinds."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    known, own = np.unique(points, return_inverse=True)
    letter = np.array([chr(c).isalpha() for c in known.tolist()], bool)[own] if len(known) else np.zeros(0, bool)
    out, n = points.copy(), int(letter.sum())
    if kind <= 2:
        low, high = SCRIPTS[0 if kind < 2 else int(rng.integers(1, len(SCRIPTS)))]
        out[letter] = rng.permutation(np.resize(np.arange(low, high + 1), max(len(known), high + 1 - low)))[own[letter]]
    elif kind == 3:
        out[letter] = rng.permutation(points[letter])
    elif kind == 4:
        out[letter] = rng.integers(97, 123, n)
    else:
        word = np.cumsum(~letter)
        out[letter] = rng.integers(97, 123, int(word[-1]) + 1 if len(word) else 1)[word[letter]]
    return out.astype(np.uint32).tobytes().decode("utf-32-le", "replace")


@dataclass
class Model:
    """``table`` and ``bias`` have a column for each language and a last one for none of them."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logits of each text, and its number of n-grams."""
        n = len(at) - 1
        h, text = grams(data, at, int(np.log2(len(self.table))))
        count = np.bincount(text, minlength=n)
        total = np.stack([np.bincount(text, self.table[h, c], n) for c in range(self.table.shape[1])], 1) if len(self.languages) else np.zeros((n, 0))
        return total / np.maximum(count, 1)[:, None] + self.bias, count

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language number, confidence, and whether it is accepted."""
        z, count = self.logits(*common.raw(pc.utf8_lower(texts)))
        if not self.languages:
            return np.zeros(len(z), int), np.zeros(len(z)), np.zeros(len(z), bool)
        p = _softmax(z / self.temperature)
        best = p[:, :-1].argmax(1)
        sure = np.where(count > 0, p[np.arange(len(p)), best], 0.0)
        return best, sure, (count > 0) & (1 - p[:, -1] >= max(self.threshold, 0.5))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(texts: list[str], labels: list[str], bits: int = BITS, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, risk: float = RISK, seed: int = 5) -> Model:
    """Train, calibrate and set the threshold."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((1 << bits, 0)), np.zeros(0))
    y_all = np.array([languages.index(x) for x in labels])
    held = np.arange(len(texts)) % 5 == 4 if len(texts) >= 50 else np.zeros(len(texts), bool)
    examples, held_out = [], []
    for i, t in enumerate(texts):
        for text, label in ((t.lower(), y_all[i]), (foreign(t, i // 5 % 6, rng), len(languages))):
            data = np.frombuffer(text.encode(errors="replace"), np.uint8)
            parts = [data]
            for _ in range(STRETCHES):
                size = int(rng.integers(SHORT, LONG))
                if len(data) > size:
                    a = int(rng.integers(0, len(data) - size))
                    parts.append(data[a : a + size])
            for part in parts:
                h, _ = grams(part, np.array([0, len(part)]), bits)
                if len(h):
                    ids, n = np.unique(h, return_counts=True)
                    (held_out if held[i] else examples).append((ids, (n / n.sum()).astype(np.float32)[:, None], label))
    e = rng.normal(0, 0.1, (1 << bits, dim)).astype(np.float32)
    w, bias = rng.normal(0, 0.1, (dim, len(languages) + 1)).astype(np.float32), np.zeros(len(languages) + 1, np.float32)
    steps, done = max(1, epochs * len(examples)), 0
    for _ in range(epochs):
        for k in rng.permutation(len(examples)):
            ids, share, y = examples[k]
            lr = rate * (1 - done / steps)
            done += 1
            own = e[ids]
            mean = (own * share).sum(0)
            g = _softmax((mean @ w + bias)[None])[0]
            g[y] -= 1
            back = w @ g
            w -= lr * np.outer(mean, g)
            bias -= lr * g
            e[ids] = own - (lr * len(ids) ** 0.5) * share * back
    model = Model(languages, e @ w, bias.astype(np.float64))
    check = held_out or examples
    if check:
        z = np.array([(model.table[ids] * share).sum(0) + bias for ids, share, _ in check], np.float64)
        y = np.array([x[2] for x in check])
        losses = {t: -np.log(np.maximum(_softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean() for t in np.geomspace(0.05, 10, 60)}
        model.temperature = float(min(losses, key=losses.get))
        p = _softmax(z / model.temperature)
        known = 1 - p[:, -1]
        order = np.argsort(-known, kind="stable")
        good = np.flatnonzero(np.cumsum(y[order] == len(languages)) <= risk * np.arange(1, len(y) + 1))
        model.threshold = float(known[order[good[-1]]]) if len(good) else 1.0
    return model


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", sample: int = SAMPLE, **how) -> Model:
    """Train on at most ``sample`` labelled documents of ``docs``, those with the smallest hash of the id."""
    rows = docs.select(F.col(id_col).alias("i"), F.col(label_col).alias("l"), F.col(text_col).alias("t")).where("i is not null and l is not null and t is not null")
    ids = rows.select("i").orderBy(F.xxhash64(F.col("i").cast("string")), "i").limit(sample).distinct()
    got = sorted((str(r["i"]), r["l"], r["t"]) for r in rows.join(F.broadcast(ids), "i", "left_semi").collect())
    return train([x[2] for x in got], [x[1] for x in got], **how)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, language, confidence, accepted)`` of every document; a rejected one keeps its best guess."""
    common.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = pa.array([*m.languages, None], pa.string())
        for batch in batches:
            for a, b in common.slices(batch.column(1)):
                best, sure, good = m.predict(batch.column(1).slice(a, b - a))
                best = np.where(sure > 0, best, len(m.languages))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), names.take(pa.array(best)), pa.array(sure.round(6)), pa.array(good)], ["doc_id", "language", "confidence", "accepted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, language string, confidence double, accepted boolean")


def keep_known(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is accepted; columns as they were."""
    common.small_batches(docs.sparkSession)
    shared, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [shared.value.predict(batch.column(place).slice(a, b - a))[2] for a, b in common.slices(batch.column(place))]
            yield batch.filter(pa.array(np.concatenate(good))) if good else batch

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, fit(docs))
