"""Quality classification by co-training.

Two views of a document that share nothing: its text (rates of symbols, capitals, repeats, ...)
and its page's metadata (language, source, size as the table gives it). A ridge-regularised
logistic model of each view learns from labelled rows; then over ROUNDS the views teach each
other: documents that one view is sure of become weighted pseudo-labels for the other. Labels
of a calibration fold are left out until the end, where they fit the weights that make the
two views' log-odds one probability. All documents take part in every pass: a Newton
step needs only sums of outer products, which each task adds up and Spark adds over tasks;
one row for each cell of matrices of a fixed size reaches the driver. Both views are fitted in
one pass, as a round's views learn from those of the round before.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, slices, table

ROUNDS, SURE, PSEUDO_WEIGHT, RIDGE, STEPS = 2, 0.95, 0.2, 1.0, 7
#: The longest step of a weight: where views part the labels wholly, full Newton steps run away.
LONGEST_STEP = 1.5
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXT, META = 14, 48


def text_view(text: str) -> list[float]:
    words = WORD.findall(text)
    n = max(1, len(words))
    letters = max(1, sum(map(str.isalpha, text)))
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    lines = [x for x in text.split("\n") if x.strip()]
    counts = [sum(map(text.count, "#*$%&<>")), text.count("!"), text.count("|"), sum(map(str.isdigit, text)), text.count("."), text.count(",")]
    return [
        *[math.log1p(c / n * 10) for c in counts],
        sum(map(str.isupper, text)) / letters,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        sum(c for c in windows.values() if c > 1) / n,
        len(set(words)) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        math.log1p(sum(map(len, words)) / n),
        sum(len(w) > 15 for w in words) / n,
        sum(map(text.lower().count, "aeiouáàâäéèêëíóöúüy")) / letters,
    ]


def meta_view(lang: str | None, source: str | None, size: int | None) -> list[float]:
    out = [0.0] * META
    out[zlib.crc32((lang or "").encode()) % 8] = 1.0
    out[8 + zlib.crc32((source or "").encode()) % 32] = 1.0
    n = max(0, size or 0)
    out[40:44] = [math.log1p(n), float(n < 200), float(n < 1000), float(n > 20_000)]
    return out


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Views:
    """Both models: standardisation and weights; log-odds of each view."""

    def __init__(self):
        self.mean, self.scale = np.zeros(TEXT + META), np.ones(TEXT + META)
        self.text, self.meta, self.stack = np.zeros(2 * TEXT + 1), np.zeros(META + 1), np.array([1.0, 1.0, 0.0])

    def design(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = np.clip((x - self.mean) / self.scale, -4, 4)
        one = np.ones((len(x), 1))
        return np.hstack((z[:, :TEXT], z[:, :TEXT] ** 2 - 1, one)), np.hstack((z[:, TEXT:], one))

    def odds(self, x: np.ndarray) -> np.ndarray:
        a, b = self.design(x)
        return np.clip(np.stack((a @ self.text, b @ self.meta, np.ones(len(x))), axis=1), -12, 12)


def _sums(table_: DataFrame, make) -> np.ndarray | None:
    """Add up the arrays that make(x, y, fold) gives for each batch, in the cluster; the arrays' size doesn't depend on the data. None without rows."""

    def run(batches):
        total = None
        for b in batches:
            if b.num_rows:
                x = np.frombuffer(b"".join(b.column("x").to_pylist()), dtype=np.float32).reshape(b.num_rows, -1).astype(float)
                got = make(x, np.array(b.column("y").to_pylist()), np.array(b.column("fold").to_pylist()))
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(len(total)), pa.int32()), "v": total})

    cells = table_.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()  # a row for each cell
    if not cells:
        return None
    out = np.empty(len(cells))
    out[[r.i for r in cells]] = [r.v for r in cells]
    return out


def moments(d: np.ndarray, t: np.ndarray, w: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Of a weighted logistic loss: the upper half of its curvature, row by row, and its slope."""
    p = _logistic(d @ beta)
    h = (d * (w * p * (1 - p))[:, None]).T @ d
    return np.concatenate((h[np.triu_indices(len(beta))], d.T @ (w * (t - p))))


def newton_step(beta: np.ndarray, sums: np.ndarray, ridge: float) -> np.ndarray:
    """The step of at most LONGEST_STEP in any weight."""
    n = len(beta)
    h = np.zeros((n, n))
    h[np.triu_indices(n)] = sums[: n * (n + 1) // 2]
    h = h + np.triu(h, 1).T
    step = np.linalg.solve(h + ridge * np.eye(n), sums[n * (n + 1) // 2 :] - ridge * beta)
    return step * min(1.0, LONGEST_STEP / max(1e-9, np.abs(step).max()))


def _newton(table_: DataFrame, starts: list[np.ndarray], rows, steps: int, ridge: float = RIDGE) -> list[np.ndarray]:
    """Fit several logistic models in common passes; rows(x, y, fold) gives (design, target, weight) of each."""
    betas, sizes = list(starts), [len(b) * (len(b) + 1) // 2 + len(b) for b in starts]
    for _ in range(steps):

        def make(x, y, fold, now=tuple(betas)):
            return np.concatenate([moments(*r, b) for r, b in zip(rows(x, y, fold), now, strict=True)])

        total = _sums(table_, make)
        if total is None:
            return betas
        step = [newton_step(b, part, ridge) for b, part in zip(betas, np.split(total, np.cumsum(sizes)[:-1]), strict=True)]
        betas = [b + s for b, s in zip(betas, step, strict=True)]
        if max(np.abs(s).max() for s in step) < 1e-3:
            break
    return betas


def cotrain(features: DataFrame, rounds: int = ROUNDS) -> Views:
    """features: x (binary float32s of both views), y (0, 1, or -1 unknown), fold (0-4; 0 is held out, 1 calibrates)."""
    v = Views()
    total = _sums(features, lambda x, y, fold: np.concatenate(([len(x)], x.sum(0), (x * x).sum(0), [((y == 1) & (fold > 1)).sum(), ((y == 0) & (fold > 1)).sum()])))
    if total is None:
        return v
    n, k = total[0], TEXT + META
    v.mean = total[1 : 1 + k] / n
    v.scale = np.sqrt(np.maximum(total[1 + k : 1 + 2 * k] / n - v.mean**2, 1e-6))
    above, below = sure_odds(total[-2], total[-1])
    for round_ in range(rounds + 1):
        taught = Views()
        taught.__dict__.update(v.__dict__)

        def rows(x, y, fold, taught=taught, round_=round_):
            return lessons(taught, x, y, fold, above, below, bool(round_))

        v.text, v.meta = _newton(features, [np.zeros_like(v.text), np.zeros_like(v.meta)], rows, STEPS)
    known = Views()
    known.__dict__.update(v.__dict__)

    def stacked(x, y, fold):
        w = ((y >= 0) & (fold == 1)).astype(float)
        return [(known.odds(x), np.where(w > 0, y, 0).astype(float), w)]

    v.stack = _newton(features, [v.stack], stacked, 8, 0.1)[0]
    return v


def sure_odds(ones: float, zeros: float) -> tuple[float, float]:
    """The log-odds above and below which a view is sure.

    Its probability must be high and its evidence, the log-odds beyond the labels' own, strong:
    a view without evidence repeats the larger class, and would teach it.
    """
    prior, strong = float(np.log((ones + 1) / (zeros + 1))), float(np.log(SURE / (1 - SURE)))
    return max(0.0, prior) + strong, min(0.0, prior) - strong


def lessons(taught: Views, x: np.ndarray, y: np.ndarray, fold: np.ndarray, above: float, below: float, pseudo: bool) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(design, target, weight) of each view: labels of the learning folds, and what the other view is sure of if pseudo."""
    d = taught.design(x)
    known = (y >= 0) & (fold > 1)
    out = []
    for view, other in ((0, taught.meta), (1, taught.text)):
        t, w = np.where(known, y, 0).astype(float), known.astype(float)
        if pseudo:
            odds = d[1 - view] @ other
            sure = ~known & ((odds > above) | (odds < below))
            t, w = np.where(sure, odds > 0, t), np.where(sure, PSEUDO_WEIGHT, w)
        out.append((d[view], t, w))
    return out


def score_quality(docs: DataFrame, labels: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", size: str | None = "n_chars") -> DataFrame:
    """A row for each document: key, score (of quality 1), text_score, meta_score, predicted, kept.

    size: a column with the page's size, a part of the metadata; without it, or where it is null,
    the size counts as 0. A key labelled twice takes the smaller label; null labels are left out. Null
    texts, languages and sources are empty ones; long texts are taken whole. Rows are scored one by
    one, so repeated rows get equal scores; a score of exactly one half predicts 1. Without labels
    every score is one half, and empty docs give no rows. Other columns are not read.
    """
    known = labels.where(F.col(key).isNotNull() & F.col("quality").isNotNull()).groupBy(key).agg(F.min("quality").cast("int").alias("y"))
    kind = docs.schema[key].dataType.simpleString()

    def viewed(batches):
        for b in slices(batches):
            x = [np.array(text_view(t or "") + meta_view(g, s, n), dtype=np.float32).tobytes() for t, g, s, n in zip(*[b.column(i).to_pylist() for i in range(1, 5)], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.binary())], ["key", "x"])

    chars = F.col(size).cast("long") if size in docs.columns else F.lit(None).cast("long")
    seen = docs.select(F.col(key).alias("key"), text, "lang", "source", chars.alias("chars")).mapInArrow(viewed, f"key {kind}, x binary")
    fold = (F.crc32(F.coalesce(F.col("key").cast("string"), F.lit("")).cast("binary")) % 5).cast("int")
    joined = seen.join(known.withColumnRenamed(key, "key"), "key", "left").select("key", "x", F.coalesce("y", F.lit(-1)).alias("y"), fold.alias("fold"))
    features = scratch.save(joined, "views")
    model = cotrain(features)

    def scored(batches):
        for b in batches:
            x = np.frombuffer(b"".join(b.column(1).to_pylist()), dtype=np.float32).reshape(b.num_rows, -1).astype(float)
            odds = model.odds(x)
            p = _logistic(odds @ model.stack)
            each = [_logistic(odds[:, i]) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c) for c in (p, *each)], pa.array((p >= 0.5).astype(np.int32)), pa.array(p >= 0.5)], [key, "score", "text_score", "meta_score", "predicted", "kept"])

    return features.select("key", "x").mapInArrow(scored, f"`{key}` {kind}, score double, text_score double, meta_score double, predicted int, kept boolean")


def op8_quality(spark, sf_dir: str) -> DataFrame:
    """Quality of all documents."""
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), Scratch(spark))
