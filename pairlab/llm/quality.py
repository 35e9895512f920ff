"""Quality rules: statistics of whole texts, two base rules, and an isolation forest over the statistics.

A forest of random splits isolates odd documents in few steps. It is fitted on a bounded sample of labelled documents
(``sample`` rows at most, those whose ids hash lowest). One half of them grows it, over those rates by which a forest of
their own ranks documents labelled bad as odder than good ones (with an AUC of ``LEAST_AUC``), or over all rates if there
are none such. The other half, which it has not seen, sets its threshold: the lowest score at which at most ``max_false``
of the documents labelled good would be rejected; where they are fewer than 1 / ``max_false``, so that none may be, the
good documents of both halves set it. The statistics, base rules and verdicts cover every row.

Words are what lies between space and the control characters 0x09 to 0x0D. Defined cases: a null text has no words and
fails the base rules; rows with a null id are judged too, but have no labels; where no document labelled good passes the
base rules, these decide alone; where several rows share an id the least statistics are taken for calibration; repeated rows each give a
row; extra columns are carried only by name, and the operator's own columns win; an empty table gives an empty result.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
WINDOW = 8
LEAST_AUC = 0.6


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """How many words lie in windows of size words (a power of two) that occur twice or more."""
    if len(words) <= size:
        return 0
    number: dict[bytes, int] = {}
    names = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    step = 1
    while True:
        # Equal runs of 2 * step words get equal names.
        _, names, counts = np.unique(
            names[:-step] * (int(names.max()) + 1) + names[step:],
            return_inverse=True,
            return_counts=True,
        )
        if len(counts) == len(names):
            return 0
        step *= 2
        if step == size:
            break
    depth = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(counts[names] > 1)
    depth[at] += 1
    depth[at + size] -= 1
    return int((np.cumsum(depth) > 0).sum())


def text_statistics(text: str) -> tuple[int, ...]:
    """The values of STATS."""
    raw = text.encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    blank = sum(raw.count(c) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
    return len(words), len(text) - blank, sum(
        raw.count(c) for c in SYMBOLS
    ), len(lines) - len(set(lines)), repeated_words(words)


def features(stats: np.ndarray) -> np.ndarray:
    """Rates from the columns of STATS, none of which depends on a document's length by itself."""
    n, chars, symbols, dup, repeat = stats.T.astype(float)
    n = np.maximum(n, 1)
    return np.stack([chars / n, symbols / np.maximum(chars, 1), dup / n, repeat / n], axis=1)


@dataclasses.dataclass
class IsolationForest:
    """Trees of random splits, each laid out in arrays; node 0 is the root and a leaf has feature -1."""

    feature: np.ndarray
    split: np.ndarray
    child: np.ndarray
    depth: np.ndarray
    norm: float
    columns: list[int]
    threshold: float = float("inf")

    @staticmethod
    def mean_path(n: float) -> float:
        """The mean depth of an unsuccessful search in a random binary tree of n rows."""
        return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n

    @classmethod
    def grow(
        cls,
        rows: np.ndarray,
        columns: list[int],
        trees: int = 100,
        size: int = 128,
        seed: int = 7,
    ) -> IsolationForest:
        """A forest over the given columns of rows."""
        rng = np.random.default_rng(seed)
        rows = rows[:, columns]
        size = min(size, len(rows))
        deepest = max(1, int(np.ceil(np.log2(max(size, 2)))))
        nodes = 2 ** (deepest + 1) - 1
        made = cls(
            np.full((trees, nodes), -1),
            np.zeros((trees, nodes)),
            np.zeros((trees, nodes), np.int64),
            np.zeros((trees, nodes)),
            max(cls.mean_path(size), 1e-9),
            columns,
        )
        for t in range(trees):
            todo, used = [(0, rows[rng.choice(len(rows), size, replace=False)], 0)], 1
            while todo:
                at, part, level = todo.pop()
                low, high = part.min(axis=0), part.max(axis=0)
                free = np.flatnonzero(high > low)
                if level == deepest or not len(free):
                    made.depth[t, at] = level + cls.mean_path(len(part))
                    continue
                f = int(rng.choice(free))
                cut = rng.uniform(low[f], high[f])
                made.feature[t, at], made.split[t, at], made.child[t, at] = f, cut, used
                left = part[:, f] <= cut
                todo += [(used, part[left], level + 1), (used + 1, part[~left], level + 1)]
                used += 2
        return made

    def score(self, rows: np.ndarray) -> np.ndarray:
        """From 0 to 1; the higher, the sooner a row is isolated."""
        rows = rows[:, self.columns]
        total = np.zeros(len(rows))
        every = np.arange(len(rows))
        for feature, split, child, depth in zip(self.feature, self.split, self.child, self.depth, strict=True):
            at = np.zeros(len(rows), np.int64)
            while True:
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                at = np.where(inner, child[at] + (rows[every, np.maximum(f, 0)] > split[at]), at)
            total += depth[at]
        return 2.0 ** (-total / len(self.feature) / self.norm)


def auc(scores: np.ndarray, positive: np.ndarray) -> float:
    """The chance that a positive row scores higher than another; ties count half."""
    values, names, counts = np.unique(scores, return_inverse=True, return_counts=True)
    rank = (np.cumsum(counts) - (counts - 1) / 2)[names]
    n = int(positive.sum())
    return float((rank[positive].sum() - n * (n + 1) / 2) / (n * (len(scores) - n)))


def base_failed(stats: np.ndarray) -> np.ndarray:
    """Under 20 words, or over 30 % of the words in repeated windows."""
    return (stats[:, 0] < 20) | (100 * stats[:, 4] > 30 * stats[:, 0])


def statistics(
    df: DataFrame,
    forest: IsolationForest | None,
    id_col: str,
    text_col: str,
    keep: tuple[str, ...],
) -> DataFrame:
    """doc_id, STATS, base_failed, score and kept of every row, and the columns of keep."""
    names = ["doc_id", *STATS, "base_failed", "score", "kept"]
    keep = tuple(c for c in keep if c not in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = np.array(
                [text_statistics(t.as_py() or "") for t in batch.column(1)],
                np.int64,
            ).reshape(-1, len(STATS))
            failed = base_failed(stats)
            score = forest.score(features(stats)) if forest else np.zeros(len(stats))
            kept = ~failed & ~(score >= forest.threshold) if forest else ~failed
            own = [*(pa.array(c) for c in stats.T), pa.array(failed), pa.array(score), pa.array(kept)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *own, *batch.columns[2:]], names=[*names, *keep])

    schema = "doc_id long, " + ", ".join(
        f"{c} long" for c in STATS
    ) + ", base_failed boolean, score double, kept boolean"
    schema += "".join(f", `{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    chosen = df.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"), *keep)
    return chosen.mapInArrow(run, schema)


def fit_forest(
    df: DataFrame,
    labels: DataFrame,
    sample: int = 20_000,
    max_false: float = 0.005,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> IsolationForest | None:
    """A forest with its threshold, from at most sample labelled documents; None if none of the good ones passes the base
    rules.

    labels has doc_id and quality (1 good, 0 bad); an id labelled both ways counts as bad.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(
        F.min("quality").alias("quality"),
    )
    taken = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = df.withColumn("doc_id", F.col(id_col).cast("long")).join(F.broadcast(taken), "doc_id").select(
        "doc_id",
        F.col(text_col).alias("text"),
        "quality",
    )
    found = statistics(rows, None, "doc_id", "text", ("quality",)).groupBy("doc_id").agg(
        F.min(F.struct(*STATS)).alias("s"),
        F.min("quality").alias("quality"),
    )
    local = found.select("s.*", "quality", F.xxhash64("doc_id").alias("h")).orderBy("h").toPandas()
    stats, good = local[list(STATS)].to_numpy(np.int64), local["quality"].to_numpy() == 1
    usable = ~base_failed(stats)
    stats, good = stats[usable], good[usable]
    if not good.any():
        return None
    rates, grown = features(stats), np.arange(len(stats)) % 2 == 0  # in order of hash
    fit, told = rates[grown], good[grown]
    every = list(range(rates.shape[1]))
    useful = [
        c for c in every if auc(IsolationForest.grow(fit, [c]).score(fit), ~told) >= LEAST_AUC
    ] if told.any() and not told.all() else []
    forest = IsolationForest.grow(fit, useful or every)
    held = good & ~grown
    judged = held if max_false * held.sum() >= 1 else good
    allowed = int(max_false * held.sum())
    highest = np.sort(forest.score(rates[judged]))[::-1]
    # Just above the first good score that may not be rejected.
    forest.threshold = float(np.nextafter(highest[allowed], np.inf))
    return forest


def judge_quality(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Every row's statistics and verdict: doc_id, STATS, base_failed, score, kept, and the columns of keep."""
    return statistics(df, fit_forest(df, labels, id_col=id_col, text_col=text_col), id_col, text_col, keep)
