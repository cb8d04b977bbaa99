"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is the mean of the embeddings of its hashed byte n-grams; a linear layer and a softmax give
the languages' probabilities. Embeddings and layer are trained together by stochastic gradient
descent in numpy on a bounded sample of labelled rows. A temperature calibrates the probability on
rows that were not trained on, and the same rows set the level below which a text is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUCKETS = 1 << 14
DIM = 16
NGRAMS = (2, 3, 4)
#: Bytes whose n-grams are counted at a time; longer texts go block by block.
BLOCK = 1 << 20
#: The classifier is fitted on at most this many labelled rows of each language, the smallest by
#: hash of their id. It is the only bound: every row of the table is predicted from its whole text.
ROWS_PER_LANGUAGE = 600
#: A fifth of the sampled rows calibrates and is not trained on.
CALIBRATION = 5
#: Rejection gives up at most this share of the calibration rows that are predicted right.
GIVEN_UP = 0.002
UNKNOWN = "und"

_byte = np.arange(256, dtype=np.uint8)
_letter = ((_byte >= 97) & (_byte <= 122)) | (_byte >= 128)
#: A-Z to lower case, other ASCII than letters to a space, bytes of longer characters as they are.
FOLD = np.where((_byte >= 65) & (_byte <= 90), _byte + 32, np.where(_letter, _byte, 32)).astype(np.uint8)


def subword_counts(text: str) -> np.ndarray:
    """How often each hashed subword occurs in the whole text, as a vector of ``BUCKETS`` counts."""
    data = FOLD[np.frombuffer(b" " + text.encode("utf-8", "surrogatepass") + b" ", dtype=np.uint8)].astype(np.uint32)
    counts = np.zeros(BUCKETS)
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    for n in NGRAMS:
        for at in range(0, len(data) - n + 1, BLOCK):
            part = data[at : at + BLOCK + n - 1]
            gram = np.full(len(part) - n + 1, n, dtype=np.uint32)
            for k in range(n):
                gram = gram * np.uint32(0x01000193) + part[k : len(part) - n + 1 + k]
            hashed = (gram ^ (gram >> np.uint32(15))) * np.uint32(0x9E3779B1)
            counts += np.bincount((hashed >> shift).astype(np.intp), minlength=BUCKETS)
    return counts


def has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # BUCKETS x languages: embeddings times the linear layer
    bias: np.ndarray
    temperature: float
    threshold: float

    def logits(self, counts: np.ndarray) -> np.ndarray:
        return counts @ self.table / max(counts.sum(), 1.0) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and calibrated probability; ``und`` and 0 for null or a text without letters."""
        if not has_letter(text):
            return UNKNOWN, 0.0
        p = softmax(self.logits(subword_counts(text)) / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _examples(text: str, rng: np.random.Generator) -> list[str]:
    """The whole text and two short runs of its words, so that short texts are learned too."""
    words = text.split()
    out = [text]
    for n in (4, 16):
        if len(words) > n:
            at = int(rng.integers(len(words) - n))
            out.append(" ".join(words[at : at + n]))
    return out


def fit(rows: list[tuple[str, str]], epochs: int = 6, batch: int = 64, rate: float = 4.0, seed: int = 7) -> Model:
    """Train and calibrate on ``(text, language)`` rows; the same rows in any order give the same model."""
    rows = sorted(r for r in rows if has_letter(r[0]))
    languages = sorted({r[1] for r in rows})
    if not languages:
        return Model([UNKNOWN], np.zeros((BUCKETS, 1)), np.zeros(1), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    held = [i for i in range(len(rows)) if i % CALIBRATION == 0] if len(rows) >= 4 * CALIBRATION else []
    train = [(t, languages.index(y)) for i, (x, y) in enumerate(rows) if i not in set(held) for t in _examples(x, rng)]
    sparse = []  # buckets that occur and their shares; a batch at a time is made dense
    for t, _ in train:
        c = subword_counts(t)
        at = np.flatnonzero(c)
        sparse.append((at.astype(np.int32), (c[at] / c.sum()).astype(np.float32)))
    y = np.array([k for _, k in train])
    emb = rng.uniform(-1.0, 1.0, (BUCKETS, DIM)).astype(np.float32)
    lin = rng.uniform(-0.1, 0.1, (DIM, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), dtype=np.float32)
    steps, done = epochs * -(-len(y) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            pick = order[at : at + batch]
            x = np.zeros((len(pick), BUCKETS), dtype=np.float32)
            for i, k in enumerate(pick):
                x[i, sparse[k][0]] = sparse[k][1]
            h = x @ emb
            g = softmax(h @ lin + bias)
            g[np.arange(len(pick)), y[pick]] -= 1.0
            g /= len(pick)
            step = rate * (1.0 - done / steps)
            back = g @ lin.T
            lin -= step * (h.T @ g)
            bias -= step * g.sum(axis=0)
            # the mean of n-grams spreads a text's gradient over them: embeddings take a larger step
            emb -= step * 100.0 * (x.T @ back)
            done += 1
    model = Model(languages, (emb.astype(np.float64) @ lin.astype(np.float64)), bias.astype(np.float64), 1.0, 0.0)
    if held:
        z = np.array([model.logits(subword_counts(t)) for i in held for t in _examples(rows[i][0], rng)])
        truth = np.array([languages.index(rows[i][1]) for i in held for _ in range(len(_examples(rows[i][0], rng)))])
        loss = lambda t: -np.log(np.maximum(softmax(z / t)[np.arange(len(truth)), truth], 1e-12)).mean()
        model.temperature = float(min(np.geomspace(0.25, 8.0, 41), key=loss))
        p = softmax(z / model.temperature)
        right = np.sort(p.max(axis=1)[p.argmax(axis=1) == truth])
        if len(right):
            model.threshold = float(min(0.5, right[int(GIVEN_UP * len(right))]))
    return model


def training_rows(docs: DataFrame, per_language: int = ROWS_PER_LANGUAGE) -> DataFrame:
    """``text, lang`` of the bounded sample, chosen by hash of the id among the rows not held out."""
    learn = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (held_out("doc_id") == F.lit(False)) & F.col("doc_id").isNotNull())
    # by its language's count, about four times the rows wanted pass a threshold on the hash; those are ranked
    counts = learn.groupBy("lang").agg(F.count(F.lit(1)).alias("_rows"))  # one row a language
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)).cast("double") / float(1 << 40)
    place = share * F.col("_rows") <= 4.0 * per_language
    near = learn.select("doc_id", "lang").join(F.broadcast(counts), "lang").filter(place).select("doc_id", "lang")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit("rank")), "doc_id"))
    chosen = near.withColumn("_rank", rank).filter(F.col("_rank") <= per_language)
    ids = chosen.select("doc_id", "lang").distinct()  # at most per_language rows a language
    return learn.join(F.broadcast(ids), ["doc_id", "lang"], "left_semi").select("text", "lang")


def held_out(id_col: str):
    """crc32 of the id as text leaves remainder 0 modulo 5 (a null id: false)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame) -> Model:
    """Fit on the bounded sample of ``docs(doc_id, text, lang)``; only texts and languages are learned from."""
    return fit([(r["text"], r["lang"]) for r in training_rows(docs).collect()])


def _predictions(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(**shared.value)
        for b in batches:
            found = [model.predict(t.as_py()) for t in b.column(1)]
            lang, score = pa.array([f[0] for f in found], pa.string()), np.array([f[1] for f in found], dtype=float)
            rejected = np.array([f[0] == UNKNOWN for f in found], dtype=bool) | (score < model.threshold)
            yield pa.RecordBatch.from_arrays([b.column(0), lang, pa.array(score), pa.array(rejected)], ["doc_id", "lang_pred", "score", "rejected"])

    return run


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, rejected`` for every row, from the whole text alone.

    ``score`` is the calibrated probability of ``lang_pred``. Null texts and texts without a letter
    are ``und`` with score 0 and rejected; a text is also rejected when its score is below the
    model's level. Rows stay rows: repeated ids are each predicted, an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(asdict(model))  # BUCKETS x languages numbers
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(_predictions(shared), "doc_id bigint, lang_pred string, score double, rejected boolean")
    return out.withColumnRenamed("doc_id", id_col) if id_col != "doc_id" else out


def _accepted(shared, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(**shared.value)
        for b in batches:
            found = (model.predict(t.as_py()) for t in b.column(at))
            yield b.filter(pa.array([lang != UNKNOWN and score >= model.threshold for lang, score in found], pa.bool_()))

    return run


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose language is identified; see ``identify``. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(asdict(model))  # BUCKETS x languages numbers
    return docs.mapInArrow(_accepted(shared, docs.columns.index(text_col)), docs.schema)
