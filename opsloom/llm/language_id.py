"""Language identification by a byte convolutional network.

A text is lower-cased, encoded as UTF-8, and its bytes mapped to classes (letters, bytes beyond ASCII, everything else
as a blank). Windows of a fixed length cover the whole text. Filters of several widths slide over each window, each
keeps its maximum over the window, and a softmax layer turns the maxima into language probabilities; the text's are the
mean of its windows', weighted by the letters in them. The network is trained in numpy by stochastic gradients on a
bounded sample of labelled rows.

Texts that are null or hold no letter are `und` with score 0. A text of any length is read whole, in one task, a block of
windows at a time. Rows are classified one by one, so ties, repeated rows and extra columns change nothing; a column named as
the result is replaced. An empty table gives an empty table. Without labelled rows every text is `und`.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WINDOW = 128
WIDTHS, FILTERS = (2, 3, 4), 16
#: Bounds of the training sample: rows of a language, and windows of a row.
SAMPLE_ROWS, SAMPLE_WINDOWS = 400, 3
EPOCHS, BATCH, RATE = 12, 64, 0.01
#: Windows that are scored at once.
BLOCK = 512
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")


def byte_classes() -> np.ndarray:
    """0 for blanks, digits and signs, then the ASCII letters, then the bytes beyond ASCII."""
    classes = np.zeros(256, dtype=np.uint8)
    classes[ord("a") : ord("z") + 1] = np.arange(1, 27)
    classes[128:] = np.arange(27, 155)
    return classes


CLASSES = byte_classes()
N_CLASSES = 155


def windows_of(text: str) -> np.ndarray:
    """The byte classes of the whole text in rows of WINDOW; the last row is padded with blanks."""
    data = CLASSES[np.frombuffer(text.lower().encode("utf-8", "replace"), dtype=np.uint8)]
    rows = max(1, -(-len(data) // WINDOW))
    out = np.zeros(rows * WINDOW, dtype=np.uint8)
    out[: len(data)] = data
    return out.reshape(rows, WINDOW)


@dataclass(frozen=True)
class Network:
    """Fixed-size weights: for each width an array of (width, classes, filters), their biases, and the softmax layer."""

    languages: tuple[str, ...]
    filters: tuple[np.ndarray, ...]
    biases: tuple[np.ndarray, ...]
    dense: np.ndarray
    dense_bias: np.ndarray


class Scorer:
    """Evaluates a network by table look-ups: two neighbouring bytes index one row of filter responses."""

    def __init__(self, net: Network):
        self.net = net
        self.tables = []
        for w in net.filters:
            width, tables = len(w), []
            for j in range(0, width - 1, 2):
                tables.append((j, (w[j][:, None, :] + w[j + 1][None, :, :]).reshape(-1, w.shape[2]).astype(np.float32)))
            if width % 2:
                tables.append((width - 1, w[-1].astype(np.float32)))
            self.tables.append((width, tables))

    def pooled(self, rows: np.ndarray) -> np.ndarray:
        """The filters' maxima over each window, rectified."""
        pairs = rows[:, :-1].astype(np.int32) * N_CLASSES + rows[:, 1:]
        out = []
        for (width, tables), bias in zip(self.tables, self.net.biases, strict=True):
            span = rows.shape[1] - width + 1
            total = None
            for j, t in tables:
                index = pairs[:, j : j + span] if len(t) > N_CLASSES else rows[:, j : j + span]
                part = np.take(t, index, axis=0)
                total = part if total is None else np.add(total, part, out=total)
            out.append(np.maximum(total.max(axis=1) + bias, 0))
        return np.concatenate(out, axis=1)

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        z = self.pooled(rows) @ self.net.dense + self.net.dense_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def classify(self, texts: list) -> tuple[list, list]:
        """Language and score of each text; all windows of a batch are scored in blocks of BLOCK."""
        known = [bool(t) and bool(self.net.languages) and LETTER.search(t) is not None for t in texts]
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        pending, owners, held = [], [], 0
        sums = {}

        def flush():
            nonlocal held
            if pending:
                rows = np.concatenate(pending)
                weight = (rows > 0).sum(axis=1, keepdims=True) + 1e-3
                start = 0
                gained = np.concatenate([self.probabilities(rows[i : i + BLOCK]) for i in range(0, len(rows), BLOCK)]) * weight
                for i, n in owners:
                    sums[i] = sums.get(i, 0) + gained[start : start + n].sum(axis=0)
                    start += n
                pending.clear()
                owners.clear()
                held = 0

        for i, text in enumerate(texts):
            if known[i]:
                rows = windows_of(text)
                for a in range(0, len(rows), 8 * BLOCK):
                    part = rows[a : a + 8 * BLOCK]
                    pending.append(part)
                    owners.append((i, len(part)))
                    held += len(part)
                    if held >= 8 * BLOCK:
                        flush()
        flush()
        for i, s in sums.items():
            best = int(s.argmax())
            names[i], scores[i] = self.net.languages[best], round(float(s[best] / s.sum()), 9)  # sums differ in the last bits by batch
        return names, scores


def train(rows: np.ndarray, targets: np.ndarray, languages: tuple[str, ...], seed: int = 7) -> Network:
    """Adam on the cross-entropy of single windows; only the window positions that won the pooling receive gradients."""
    rng = np.random.default_rng(seed)
    k = len(languages)
    params = [rng.normal(0, 0.3, (w, N_CLASSES, FILTERS)) for w in WIDTHS]
    params += [np.zeros(FILTERS) for _ in WIDTHS]
    params += [rng.normal(0, 0.3, (len(WIDTHS) * FILTERS, k)), np.zeros(k)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step, n = 0, len(WIDTHS)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for a in range(0, len(order), BATCH):
            x, y = rows[order[a : a + BATCH]].astype(np.int64), targets[order[a : a + BATCH]]
            maxima, spots = [], []
            for w, filters, bias in zip(WIDTHS, params[:n], params[n : 2 * n], strict=True):
                span = x.shape[1] - w + 1
                total = sum(filters[j][x[:, j : j + span]] for j in range(w)) + bias
                spots.append(total.argmax(axis=1))
                maxima.append(total.max(axis=1))
            h = np.maximum(np.concatenate(maxima, axis=1), 0)
            z = h @ params[-2] + params[-1]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            p /= len(y)
            back = (p @ params[-2].T) * (h > 0)
            grads = [np.zeros_like(q) for q in params]
            grads[-2], grads[-1] = h.T @ p, p.sum(axis=0)
            for i, w in enumerate(WIDTHS):
                own = back[:, i * FILTERS : (i + 1) * FILTERS]
                grads[n + i] = own.sum(axis=0)
                for j in range(w):
                    np.add.at(grads[i][j], (np.take_along_axis(x, spots[i] + j, axis=1), np.arange(FILTERS)[None, :]), own)
            step += 1
            for q, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                q -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Network(languages, tuple(params[:n]), tuple(params[n : 2 * n]), params[-2], params[-1])


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Network:
    """Trains on at most SAMPLE_ROWS different texts of each language, chosen by a hash of the text, and SAMPLE_WINDOWS
    windows of each, spread over the text. Copies of a text count once, however many there are."""
    rows = docs.select(F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"))
    rows = rows.where(F.col("_lang").isNotNull() & F.col("_text").rlike(r"\p{L}")).withColumn("_hash", F.xxhash64("_text"))
    # Half as many again as are wanted, by the number of different texts, so that few rows are shuffled and ranked.
    n = rows.groupBy("_lang").agg(F.approx_count_distinct("_hash").alias("_n"))
    rows = rows.join(F.broadcast(n), "_lang")  # a row for each language
    rows = rows.where(F.pmod("_hash", F.lit(1_000_000)) * F.col("_n") < 1_500_000 * SAMPLE_ROWS)
    n = F.length("_text")
    parts = [F.substring("_text", (F.greatest(n - WINDOW, F.lit(0)) * i / max(1, SAMPLE_WINDOWS - 1) + 1).cast("int"), WINDOW) for i in range(SAMPLE_WINDOWS)]
    cut = rows.select("_lang", "_hash", F.array(*parts).alias("_parts")).groupBy("_lang", "_hash").agg(F.min("_parts").alias("_parts"))
    rank = F.row_number().over(Window.partitionBy("_lang").orderBy(F.pmod("_hash", F.lit(1_000_000)), "_hash"))
    sample = cut.withColumn("_rank", rank).where(F.col("_rank") <= SAMPLE_ROWS).select("_lang", "_hash", "_parts").collect()
    sample = sorted(sample, key=lambda r: (r["_lang"], r["_hash"], r["_parts"]))
    languages = tuple(sorted({r["_lang"] for r in sample}))
    if not languages:
        none = np.zeros(0)
        return Network((), (), (), none, none)
    rows, targets = [], []
    for r in sample:
        for part in dict.fromkeys(r["_parts"]):
            if LETTER.search(part):
                rows.append(windows_of(part)[0])
                targets.append(languages.index(r["_lang"]))
    return train(np.array(rows), np.array(targets), languages)


def classify(df: DataFrame, net: Network, text_col: str = "text", out_col: str = "language") -> DataFrame:
    """`df` with `out_col`, a struct of `lang` and `score`."""
    shared = df.sparkSession.sparkContext.broadcast(net)

    @F.arrow_udf("lang string, score double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(shared.value)
        for texts in batches:
            names, scores = scorer.classify(texts.to_pylist())
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["lang", "score"])

    return df.withColumn(out_col, run(F.col(text_col)))
