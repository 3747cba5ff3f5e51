"""Quality classification by co-training of a text view and a metadata view.

The text view has marks of a document's whole text (signs, capitals, repetition, lines) and its words, hashed; the metadata
view knows its source, language and size only, as the table carries them. A logistic classifier of each view is trained on the
labelled rows. Over `ROUNDS` rounds each view labels the unlabelled rows that it is most confident of, a balanced number for
each label, and those enter the other view's training rows. Each view's log-odds are calibrated by a logistic curve on
labelled rows held back from the training, and the calibrated views are combined by a logistic model on other rows held
back, which then scores every document.

The classifiers are fitted in numpy on a bounded sample: at most about `SAMPLE_LABELLED` labelled and `SAMPLE_POOL`
unlabelled rows, by a hash of the id. Scoring covers every row and its whole text. A null or empty text has an empty text
view and is scored by its metadata; null metadata is a value of its own. A text of any length is read whole, in one task. Rows
are scored one by one: ties, repeated rows and extra columns change nothing; a column named as the result is replaced. An empty
table gives an empty table. Where labels repeat an id, its greatest label holds. Without labelled rows of both kinds every
score is 0.5.
"""

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.llm.common import values
from opsloom.llm.toxicity import logistic
from opsloom.llm.words import word_hashes

SAMPLE_LABELLED, SAMPLE_POOL = 6000, 6000
ROUNDS, GAIN, CONFIDENCE = 4, 200, 0.9
N_HASHED, N_META = 256, 32
N_DENSE = 12
SYMBOLS, UPPER = b"#*$%&|<>", bytes(range(65, 91))
LOWER, DIGITS = bytes(range(97, 123)), bytes(range(48, 58))


def text_view(text: str) -> np.ndarray:
    """Dense marks of the whole text, then its words, hashed: the root of each one's share of all."""
    out = np.zeros(N_DENSE + N_HASHED, dtype=np.float64)
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    if not n:
        return out
    size = len(raw)

    def share(chars: bytes, of: int) -> float:
        return (size - len(raw.translate(None, chars))) / of

    distinct = len(set(words))
    pairs = len(set(zip(words, words[1:], strict=False)))
    out[:N_DENSE] = (
        min(2.0, share(SYMBOLS, n)), share(UPPER, size), share(LOWER, size), share(DIGITS, size), min(2.0, share(b"!", n)), min(1.0, share(b"|", n)),
        share(b".,;:", n), distinct / n, pairs / n, min(2.0, (size / n) / 10), min(1.0, np.log1p(n) / 10), min(1.0, 10 * raw.count(b"\n") / n),
    )
    hashed = (word_hashes(raw.lower()) >> np.uint64(40)).astype(np.int64) % N_HASHED
    out[N_DENSE:] = np.sqrt(np.bincount(hashed, minlength=N_HASHED) / n)
    return out


def meta_view(meta: dict) -> np.ndarray:
    """The hashed metadata: each column's value, numbers in steps of twice the size. The text isn't looked at."""
    out = np.zeros(N_META, dtype=np.float64)
    for name, value in meta.items():
        step = int(np.log2(abs(value) + 1)) if isinstance(value, (int, float)) and np.isfinite(value) else value
        out[xxhash.xxh3_64_intdigest(f"{name}={step}") % N_META] += 1.0
    return out


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logit(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.clip(w[0] + x @ w[1:], -30, 30)


@dataclass(frozen=True)
class CoTrained:
    """Fixed-size weights: of each view, of each view's calibration, and of the combination of the calibrated log-odds."""

    text: np.ndarray
    meta: np.ndarray
    curves: tuple[np.ndarray, np.ndarray]
    both: np.ndarray

    def calibrated(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        odds = (logit(self.text, text), logit(self.meta, meta))
        return np.stack([logit(curve, x[:, None]) for curve, x in zip(self.curves, odds, strict=True)], axis=1)

    def score(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        return sigmoid(logit(self.both, self.calibrated(text, meta)))


#: A calibration and a combination that change nothing, for want of rows to fit them on.
AS_IS, SUM = np.array([0.0, 1.0]), np.array([0.0, 1.0, 1.0])


def confident(w: np.ndarray, x: np.ndarray, free: np.ndarray) -> list[tuple[int, int]]:
    """The rows of the pool that a view is surest of, GAIN of each label at most, where it is sure enough."""
    p = sigmoid(logit(w, x))
    picked = []
    for label, q in ((1, p), (0, 1 - p)):
        order = np.argsort(-q, kind="stable")
        picked += [(int(i), label) for i in order[free[order] & (q[order] >= CONFIDENCE)][:GAIN]]
    return picked


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, pool_text: np.ndarray, pool_meta: np.ndarray) -> CoTrained:
    back = np.arange(len(y)) % 4 == 0
    own = {"text": [text[~back], y[~back]], "meta": [meta[~back], y[~back]]}
    free = {v: np.ones(len(pool_text), dtype=bool) for v in own}
    pools = {"text": pool_text, "meta": pool_meta}
    for _ in range(ROUNDS):
        weights = {v: logistic(x, t) for v, (x, t) in own.items()}
        for teacher, pupil in (("text", "meta"), ("meta", "text")):
            gained = confident(weights[teacher], pools[teacher], free[pupil])
            if gained:
                rows, labels = np.array([i for i, _ in gained]), np.array([t for _, t in gained], dtype=float)
                free[pupil][rows] = False
                own[pupil] = [np.concatenate([own[pupil][0], pools[pupil][rows]]), np.concatenate([own[pupil][1], labels])]
    weights = {v: logistic(x, t) for v, (x, t) in own.items()}
    first, second = (np.arange(len(y)) % 8 == k for k in (0, 4))
    curves = []
    for v, x in (("text", text), ("meta", meta)):
        odds = logit(weights[v], x[first])[:, None]
        curves.append(logistic(odds, y[first]) if len(set(y[first])) == 2 else AS_IS)
    model = CoTrained(weights["text"], weights["meta"], tuple(curves), SUM)
    if len(set(y[second])) == 2:
        model = replace(model, both=logistic(model.calibrated(text[second], meta[second]), y[second]))
    return model


def fit(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="quality", meta_cols=("source", "lang", "n_chars")) -> CoTrained:
    marks = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_label"))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.struct(*[F.col(c) for c in meta_cols]).alias("_meta"))
    n_all, n_marked = docs.count(), marks.count()
    spot = F.pmod(F.xxhash64(F.lit("quality"), "_id"), F.lit(1_000_000))
    share = F.when(F.col("_label").isNotNull(), SAMPLE_LABELLED / max(1, n_marked)).otherwise(SAMPLE_POOL / max(1, n_all - n_marked))
    # The hash comes first and bounds what is joined, viewed and sent.
    most = 1_000_000 * max(SAMPLE_LABELLED / max(1, n_marked), SAMPLE_POOL / max(1, n_all - n_marked))
    rows = rows.where(spot < most).join(marks.where(spot < most), "_id", "left").where(spot < share * 1_000_000)

    @F.arrow_udf("array<double>")
    def view_of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, metas in batches:
            yield pa.array(list(views(texts, metas)), pa.list_(pa.float64()))

    seen = rows.select("_id", "_label", view_of("_text", "_meta").alias("v")).toPandas().sort_values("_id", kind="stable")
    x = np.array(seen["v"].tolist(), dtype=np.float64).reshape(len(seen), N_DENSE + N_HASHED + N_META)
    text, meta = x[:, : N_DENSE + N_HASHED], x[:, N_DENSE + N_HASHED :]
    marked = seen["_label"].notna().to_numpy(bool)
    y = seen["_label"].to_numpy(float)[marked]
    if len(set(y)) < 2:
        return CoTrained(np.zeros(1 + text.shape[1]), np.zeros(1 + meta.shape[1]), (AS_IS, AS_IS), np.zeros(3))
    return co_train(text[marked], meta[marked], y, text[~marked], meta[~marked])


def views(texts: pa.Array, metas: pa.Array) -> np.ndarray:
    return np.array([np.concatenate([text_view(t or ""), meta_view(m)]) for t, m in zip(values(texts), values(metas), strict=True)])


def score(df: DataFrame, model: CoTrained, text_col="text", meta_cols=("source", "lang", "n_chars"), out_col: str = "quality_score") -> DataFrame:
    """`df` with `out_col`: how likely the document is good, 0 to 1."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        n = N_DENSE + N_HASHED
        for texts, metas in batches:
            x = views(texts, metas).reshape(len(texts), n + N_META)
            yield pa.array(shared.value.score(x[:, :n], x[:, n:]), pa.float64())

    return df.withColumn(out_col, run(F.col(text_col), F.struct(*[F.col(c) for c in meta_cols])))
