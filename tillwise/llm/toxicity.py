"""Toxicity categories by a chain of linear classifiers with out-of-fold predictions."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.llm.common import Words, mix, slices, text_or_empty, written
from tillwise.llm.risk_rules import COST

#: labelled rows that the chain is fitted on, picked by a hash of the id; all rows are scored
SAMPLE = 20_000
#: features for each category, texts that must hold one, and folds
FEATURES, SUPPORT, FOLDS = 1024, 8, 5
#: least log odds ratio of a feature, in standard errors
LEAST_Z = 2.5
#: probabilities that are tried as cuts, from the mildest on: even steps of log odds, fixed beforehand
CUTS = 1 / (1 + np.exp(-np.arange(80, -81, -1) / 10))
#: byte lengths of the word beginnings that are features beside whole words
PREFIXES = (4, 5, 6)

# words of the classifier are runs of letters and digits; bytes of characters beyond ASCII belong to words
_NO_WORD = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


class Known:
    """A set of features: a table of their low bits turns most others away before the exact look-up."""

    def __init__(self, features: np.ndarray):
        self.features = np.unique(features)
        self.low = np.zeros(1 << 20, dtype=bool)
        self.low[(self.features & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def hits(self, code: np.ndarray) -> np.ndarray:
        """Positions in `code` that hold one of the features."""
        some = np.flatnonzero(self.low[(code & np.uint64((1 << 20) - 1)).astype(np.int64)])
        return some[np.isin(code[some], self.features)]


def text_features(texts: pa.Array, known: Known | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) pairs, each once: hashes of whole words and of word beginnings, A-Z folded. With `known`,
    only of its features."""
    words = Words(texts, _NO_WORD)
    rows, codes = [], []
    for size in (0, *PREFIXES):
        some, code = words.prefix_hashes(size) if size else (np.arange(len(words.row)), words.hashes(lower=True))
        if known is not None:
            hit = known.hits(code)
            some, code = some[hit], code[hit]
        rows.append(words.row[some])
        codes.append(code)
    row, code = np.concatenate(rows), np.concatenate(codes)
    order = np.lexsort((code, row))
    row, code = row[order], code[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (code[1:] != code[:-1])
    return row[new], code[new]


def fit_linear(rows: np.ndarray, columns: np.ndarray, extra: np.ndarray, target: np.ndarray, width: int, ridge: float = 5e-5,
               rounds: int = 150) -> np.ndarray:
    """Logistic regression by gradient steps with momentum over sparse 0/1 features (rows, columns) and dense
    `extra` columns. Returns width + extra + 1 weights; the last is the constant."""
    n, more = len(target), extra.shape[1]
    weights = np.zeros(width + more + 1)
    speed, second = np.zeros_like(weights), np.zeros_like(weights)
    for t in range(1, rounds + 1):
        score = np.bincount(rows, weights[columns], n) + extra @ weights[width:-1] + weights[-1]
        miss = 1 / (1 + np.exp(-np.clip(score, -30, 30))) - target
        slope = np.concatenate([np.bincount(columns, miss[rows], width), extra.T @ miss, [miss.sum()]]) / n
        if t % 10 == 0 and np.abs(slope).max() < 1e-5:
            break
        slope[:-1] += ridge * weights[:-1]
        speed = 0.9 * speed + 0.1 * slope
        second = 0.99 * second + 0.01 * slope * slope
        weights = weights - 0.1 * (speed / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    return weights


@dataclass
class Link:
    """One classifier of the chain: its features (sorted hashes), their weights, those of the earlier
    categories' probabilities, the constant, and the least probability that rejects (infinite: none does)."""

    name: str
    features: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    constant: float
    cut: float = math.inf


def score_rows(chain: list[Link], row: np.ndarray, code: np.ndarray, n: int) -> np.ndarray:
    """n x categories probabilities, each category from the features and the probabilities before it."""
    out = np.zeros((n, len(chain)))
    for k, link in enumerate(chain):
        score = np.full(n, link.constant)
        if len(link.features):
            place = np.minimum(np.searchsorted(link.features, code), len(link.features) - 1)
            hit = link.features[place] == code
            score += np.bincount(row[hit], link.weights[place[hit]], n)
        score += out[:, :k] @ link.earlier
        out[:, k] = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    return out


def most_false(n: int, risk: float, doubt: float) -> int:
    """The largest k with P(Bin(n, risk) <= k) <= doubt, that is, so many false rejections among n that their
    Clopper-Pearson upper bound still lies under `risk`; -1 if n is too small for any."""
    tail, k = 0.0, -1
    while k < n:
        i = k + 1
        tail += math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(risk) + (n - i) * math.log1p(-risk))
        if tail > doubt:
            break
        k = i
    return k


def certified_cut(scores: np.ndarray, target: np.ndarray, floor: float, risk: float, doubt: float) -> float:
    """The most useful of the CUTS above `floor` that are certified on out-of-fold `scores`; infinite if none is.

    A cut is certified if the exact binomial upper bound of its false rejections lies under `risk` with
    probability 1 - doubt. Cuts are tested from the mildest on and false rejections only grow, so testing
    stops at the first failure and no correction is due (as in `risk_rules.certified_cutoffs`). Of the
    certified ones that with most of the category rejected, less COST for each other row, is taken; of equal
    ones the middle."""
    clean, marked = np.sort(scores[target == 0]), np.sort(scores[target == 1])
    cuts = CUTS[CUTS > floor]
    false = len(clean) - np.searchsorted(clean, cuts)
    held = false <= most_false(len(clean), risk, doubt)
    cuts, false = cuts[held], false[held]
    gain = len(marked) - np.searchsorted(marked, cuts) - COST * false
    if not len(cuts) or gain.max() <= 0:
        return math.inf
    best = np.flatnonzero(gain == gain.max())
    return float(cuts[best[len(best) // 2]])


def _rows(df: DataFrame, id_col: str, text_col: str, keep: dict[str, Column] | None = None) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), *[c.alias(n) for n, c in (keep or {}).items()], text_or_empty(text_col).alias("_text"))


def _folds(ids: pa.Array | pa.ChunkedArray | np.ndarray) -> np.ndarray:
    return (mix(np.asarray(ids).astype(np.int64).view(np.uint64)) % np.uint64(FOLDS)).astype(np.int64)


def fit_chain(df: DataFrame, labels: DataFrame, categories: list[str], id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE,
              risk: float = 0.05, doubt: float = 0.05) -> list[Link]:
    """Fit the chain on at most `sample` labelled rows of `df`. `labels` has the id and a 0/1 column for each
    category; a row with a null label is not used, of repeated ids one row is.

    Features are counted by Spark and the strongest for each category kept (log odds ratio, weighed by support).
    Each later category sees the earlier ones' probabilities as its own scoring will: for training rows they
    come from models that did not see the row's fold.

    The same out-of-fold probabilities give each link its cut (`certified_cut`). Models of a fold also choose
    their features without the fold's rows; else features picked by chance would look certain on the very rows
    that they were picked from. A cut lies above the probability of a text without known features, and a link
    without features of its own has none. The bound counts distinct labelled texts."""
    seen = labels.where(F.col(id_col).isNotNull()).dropna(subset=categories).groupBy(F.col(id_col).cast("long").alias("id")).agg(
        *[F.max(F.col(c).cast("int")).alias(f"y{k}") for k, c in enumerate(categories)])
    # at most `sample` rows of a few numbers: its size is bounded by the parameter
    few = seen.orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = written(_rows(df, id_col, text_col).join(F.broadcast(few), "id").dropDuplicates(["id"]).dropDuplicates(["_text"]), "toxicity-sample")
    n_cats = len(categories)

    sums = ["n", *(f"y{k}" for k in range(n_cats))]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                row, code = text_features(part.column("_text"))
                some, at = np.unique(code, return_inverse=True)
                at = at * FOLDS + _folds(part.column("id"))[row]
                marks = [np.ones(part.num_rows), *(np.asarray(part.column(f"y{k}")) for k in range(n_cats))]
                tables = [np.bincount(at, m[row], len(some) * FOLDS).astype(np.int64).reshape(-1, FOLDS) for m in marks]
                yield pa.RecordBatch.from_arrays([pa.array(some.view(np.int64)), *(pa.array(t[:, f]) for t in tables for f in range(FOLDS))], ["f", *held_by])

    # by fold, as the models of a fold do without its rows
    held_by = [f"{c}_{f}" for c in sums for f in range(FOLDS)]
    counted = texts.mapInArrow(count, "f long, " + ", ".join(f"{c} long" for c in held_by)).groupBy("f").agg(*[F.sum(c).alias(c) for c in held_by])
    counted = written(counted.where(sum(F.col(f"n_{f}") for f in range(FOLDS)) >= SUPPORT), "toxicity-features")
    # at most `sample` rows of a few numbers
    few_marks = texts.select("id", *[f"y{k}" for k in range(n_cats)]).toArrow()
    fold_of = _folds(few_marks.column("id"))
    marks = {"n": np.ones(len(fold_of)), **{f"y{k}": np.asarray(few_marks.column(f"y{k}")).astype(float) for k in range(n_cats)}}

    def choose(k: int, out: int) -> np.ndarray:
        """The strongest features of a category in the sample without fold `out`."""
        n, y = (sum(F.col(f"{c}_{f}") for f in range(FOLDS) if f != out) for c in ("n", f"y{k}"))
        all_n, all_y = (float(marks[c][fold_of != out].sum()) for c in ("n", f"y{k}"))
        yes = F.log((y + 0.5) / F.lit(all_y + 1.0))
        no = F.log((n - y + 0.5) / F.lit(all_n - all_y + 1.0))
        # the log odds ratio over its standard error tells chance from signal; weighed by support it puts what
        # many texts share before what only copies of a few share
        surely = F.abs(yes - no) / F.sqrt(1 / (y + 0.5) + 1 / (n - y + 0.5))
        strength = F.abs(yes - no) * F.sqrt(n)
        top = counted.where((n >= SUPPORT) & (surely >= LEAST_Z)).orderBy(F.desc(strength), "f").limit(FEATURES).select("f").toArrow().column("f")
        return np.sort(np.asarray(top.combine_chunks() if hasattr(top, "combine_chunks") else top).astype(np.int64).view(np.uint64))

    # the last of each category is that of the whole sample
    chosen = [[choose(k, out) for out in range(FOLDS + 1)] for k in range(n_cats)]
    union = np.unique(np.concatenate([features for some in chosen for features in some]))
    known = Known(union)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                row, code = text_features(part.column("_text"), known)
                place = np.searchsorted(union, code)
                bounds = np.searchsorted(row, np.arange(part.num_rows + 1))
                held = [place[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), *(part.column(f"y{k}") for k in range(n_cats)), pa.array(held, pa.list_(pa.int64()))], ["id", *(f"y{k}" for k in range(n_cats)), "held"])

    # at most `sample` rows of at most FEATURES x categories x (FOLDS + 1) numbers; the choices overlap by far the most
    data = texts.mapInArrow(pick, "id long, " + ", ".join(f"y{k} int" for k in range(n_cats)) + ", held array<long>").toArrow()
    ids = np.asarray(data.column("id")).astype(np.int64)
    order = np.argsort(ids)
    n = len(ids)
    fold = _folds(ids[order])
    size = np.asarray(pc.list_value_length(data.column("held"))).astype(np.int64)
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    row = np.repeat(place, size)
    held = np.asarray(pc.list_flatten(data.column("held"))).astype(np.int64)
    earlier = np.zeros((n, 0))
    chain = []
    for k, name in enumerate(categories):
        target = np.asarray(data.column(f"y{k}")).astype(float)[order]

        def fit(features: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Weights from the rows in `use`, and the scores of all rows."""
            column = np.full(len(union), -1, dtype=np.int64)
            column[np.searchsorted(union, features)] = np.arange(len(features))
            columns = column[held]
            rows, columns = row[columns >= 0], columns[columns >= 0]
            if not use.any() or target[use].min() == target[use].max():  # nothing to tell apart: a constant
                rate = (target[use].sum() + 0.5) / (use.sum() + 1.0)
                w = np.concatenate([np.zeros(len(features) + earlier.shape[1]), [np.log(rate / (1 - rate))]])
            else:
                number = np.cumsum(use) - 1
                some = use[rows]
                w = fit_linear(number[rows[some]], columns[some], earlier[use], target[use], len(features))
            return w, np.bincount(rows, w[columns], n) + earlier @ w[len(features):-1] + w[-1]

        fresh = np.zeros(n)
        for f in range(FOLDS):
            _, score = fit(chosen[k][f], fold != f)
            fresh = np.where(fold == f, 1 / (1 + np.exp(-np.clip(score, -30, 30))), fresh)
        features = chosen[k][FOLDS]
        w, _ = fit(features, np.ones(n, dtype=bool))
        link = Link(name, features, w[:len(features)], w[len(features):-1], float(w[-1]))
        chain.append(link)
        if len(features):
            nothing = score_rows(chain, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), 1)[0, k]
            link.cut = certified_cut(fresh, target, nothing, risk, doubt)
        earlier = np.column_stack([earlier, fresh])
    return chain


def toxicity_scores(df: DataFrame, chain: list[Link], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, p_<category>...) for every row, from its whole text. One map, no shuffle."""
    names = [f"p_{link.name}" for link in chain]
    union = np.concatenate([link.features for link in chain])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(union)
        for batch in batches:
            for part in slices(batch, "_text"):
                row, code = text_features(part.column("_text"), known)
                scores = score_rows(chain, row, code, part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array(s) for s in scores.T)], ["id", *names])

    return _rows(df, id_col, text_col).mapInArrow(run, "id long, " + ", ".join(f"`{n}` double" for n in names)).withColumnRenamed("id", id_col)


def toxicity(df: DataFrame, labels: DataFrame, categories: list[str], reject: str, risk: float = 0.05, doubt: float = 0.05, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """(id, p_<category>..., rejected, kept): rows whose probability of the category `reject` reaches the cut
    of its link are rejected.

    With probability 1 - doubt the cut falsely rejects at most `risk` of the texts that are like the labelled
    ones outside the category. Where no cut can be certified (too few labels, or none that separates) or
    `reject` has no features of its own, nothing is rejected.

    Null and empty texts, and any others without known features, score as the constant does and are kept;
    without labelled rows every probability is one half before smoothing and nothing is rejected; rows with the
    same id are scored one by one and null ids too. An empty table gives no rows; other columns are not read."""
    chain = fit_chain(df, labels, categories, id_col, text_col, risk=risk, doubt=doubt)
    scored = toxicity_scores(df, chain, id_col, text_col)
    cut = next(link.cut for link in chain if link.name == reject)
    return scored.withColumn("rejected", F.col(f"p_{reject}") >= F.lit(cut)).withColumn("kept", ~F.col("rejected"))
