"""Quality and toxicity by co-training of a text view and a page view.

The text view knows a document by the different words in it, without the marks around them. The page view
knows how it is set: source, language, length, lines, shares of kinds of characters, repetition and marks
that stand alone or in rows. No feature is in both. Each view is first fitted to labelled rows. In each
round both views score all rows without labels, and the rows of which one view is sure, on a calibrated
scale, are counted as examples for the other: for each feature, how many such rows of either class have it.
These sums give the other view a second opinion on each feature; it is taken up to the degree that helps
on labelled rows, and not at all where it doesn't. The calibrated views are then combined, a view that would
count against itself is left out, and all rows are scored. Scales, degrees and the combination rest on
scores that labelled rows get from views fitted to the rows of other folds.

Bounded by a parameter: about LABELLED rows with labels are fitted to, chosen by a hash of the id; their
words make up the text view. Sums and scores are of every row and its whole text.

Cases: null text is empty; null metadata is a value of its own; labels that are null are ignored and
repeated ones take the worst; repeated rows are scored, and count, each; texts of any length are read whole;
without labels of both classes a trait has no classifier, its score is null and it rejects nothing; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import SLICE, _arrow_schema, documents, only_ids, row_key
from lattica.session import checkpointed, ship_package, written

#: Rows with labels that are fitted to, about.
LABELLED = 8_000
#: Words whose places a task remembers.
REMEMBERED = 150_000
#: Rounds of exchange, and the calibrated certainty that a pseudo-label needs.
ROUNDS, SURE = 2, 0.99
#: Least quality and most toxicity of rows that are kept.
LEAST_QUALITY, MOST_TOXIC = 0.4, 0.4
#: Chi-square from which a feature counts as telling.
TELLING = 12.0
#: Documents of the sample that a word must be in, and folds of the labelled rows.
LEAST_DOCS, FOLDS = 3, 3
TRAITS = ("quality", "toxic")

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_UPPER = bytes(range(65, 91))
_MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_DIGITS = b"0123456789"
_TAIL = re.compile(rb"[^0-9A-Za-z\x80-\xff]{2,}$")
#: Bins of a layout figure, by quantiles of the sample.
BINS = 12
FIGURES = 11


def words_in(text: str) -> tuple[list[bytes], set[bytes], set[bytes]]:
    """All words; different lower-case words without marks; what marks stand alone or in rows at a word's end."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    seen = {w.strip(_MARKS) for w in set(raw.translate(_LOWER).split())}
    marks = set()
    for w in set(words):
        if not w.strip(_MARKS):
            marks.add(b"#" + w[:4])
        elif len(w) > 2 and not (w[-2:].isalnum() or w[-2] >= 48) and (m := _TAIL.search(w)):
            marks.add(b"#" + m[0][:4])
    seen.discard(b"")
    return words, seen, marks


def layout(text: str, words: list[bytes]) -> list[float]:
    raw = text.encode("utf-8", "surrogatepass")
    size, n = max(len(raw), 1), max(len(words), 1)
    lines = raw.split(b"\n")
    share = lambda chars: 1 - len(raw.translate(None, chars)) / size
    triples = len(set(zip(words, words[1:], words[2:], strict=False)))
    return [
        np.log1p(size), np.log1p(len(words)), size / n, share(_UPPER), share(_MARKS), share(_DIGITS),
        len(set(words)) / n, triples / (n - 2) if n > 2 else 1.0, np.log1p(len(lines)), len(set(lines)) / len(lines),
        sum(map(eq, words, words[1:])) / n,
    ]


def word_ids(seen: set[bytes]) -> np.ndarray:
    return np.sort(np.array([zlib.crc32(w) for w in seen], np.uint32))


def page_names(source: str | None, lang: str | None, marks: set[bytes]) -> list[str]:
    return [f"source={source}", f"lang={lang}", *[m.decode("latin-1") for m in marks]]


# -- logistic regression over sets of active features -----------------------------------------


@dataclass
class Rows:
    """Active feature numbers of each row, flat, with row starts."""

    flat: np.ndarray
    start: np.ndarray

    @staticmethod
    def of(lists: list[np.ndarray]) -> Rows:
        return Rows(np.concatenate([*lists, np.empty(0, np.int64)]).astype(np.int64), np.cumsum([0, *map(len, lists)]))

    def take(self, rows: np.ndarray) -> Rows:
        return Rows.of([self.flat[self.start[i] : self.start[i + 1]] for i in rows])

    def sums(self, weights: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(weights[self.flat])])
        return total[self.start[1:]] - total[self.start[:-1]]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Linear:
    weights: np.ndarray
    bias: float = 0.0

    def score(self, rows: Rows) -> np.ndarray:
        return rows.sums(self.weights) + self.bias


def fit(rows: Rows, y: np.ndarray, size: int, rounds: int = 80, rate: float = 0.3, decay: float = 1e-4) -> Linear:
    """Balanced classes, adaptive steps, weight decay, over the features that tell the classes apart.

    A feature takes part if its chi-square against the classes reaches TELLING: of the many words
    that say nothing each would otherwise fit a few training rows by chance.
    """
    owner = np.repeat(np.arange(len(y)), np.diff(rows.start))
    share = y.mean()
    there, good = np.bincount(rows.flat, minlength=size), np.bincount(rows.flat, y[owner], size)
    expected = there * share
    spread = expected * (1 - share) * (1 - there / len(y))
    telling = (good - expected) ** 2 >= TELLING * np.maximum(spread, 1e-9)
    stays = telling[rows.flat]
    owner, flat = owner[stays], rows.flat[stays]
    rows = Rows(flat, np.searchsorted(owner, np.arange(len(y) + 1)))
    weight = np.where(y > 0.5, 0.5 / share, 0.5 / (1 - share))
    w, b, m, mb = np.zeros(size), 0.0, np.full(size, 1e-6), 1e-6
    for _ in range(rounds):
        error = (sigmoid(rows.sums(w) + b) - y) * weight / len(y)
        g = np.bincount(rows.flat, error[owner], size) + decay * w
        m += g * g
        w -= rate * g / np.sqrt(m)
        gb = error.sum()
        mb += gb * gb
        b -= rate * gb / mb**0.5
    return Linear(w, b)


def calibrate(scores: list[np.ndarray], y: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Factors of the scores and an offset that fit the held-out classes (Newton steps, slight decay)."""
    x = np.stack([*scores, np.ones(len(y))], 1)
    scale = np.maximum(np.abs(x).mean(0), 1e-9)
    x, w = x / scale, np.zeros(x.shape[1])
    decay = np.r_[np.full(len(scores), 1e-2), 1e-6]
    for _ in range(30):
        p = sigmoid(x @ w)
        g = x.T @ (p - y) + decay * w
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(decay + 1e-9)
        w = w - np.linalg.solve(h, g)
    return w / scale


def log_loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.logaddexp(0, np.where(y > 0.5, -z, z)).mean())


VIEWS = ("text", "page")


@dataclass
class Model:
    """What executors need: bin borders, feature numbers, weights of both views, scales, combination."""

    borders: np.ndarray
    words: dict[int, int]
    pages: dict[str, int]
    views: dict[tuple[str, str], Linear] = field(default_factory=dict)
    #: Factor and offset that turn a view's score into log odds.
    scale: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)
    mix: dict[str, np.ndarray] = field(default_factory=dict)
    #: On rows to which neither a view nor the combination was fitted.
    accuracy: dict[str, float] = field(default_factory=dict)
    #: Rows that a view taught the other one, by trait, learner and class, of the last round.
    taught: dict[tuple[str, str, int], int] = field(default_factory=dict)

    def page_features(self, figures: np.ndarray, names: list[list[str]]) -> list[np.ndarray]:
        bins = np.stack([np.searchsorted(self.borders[:, i], figures[:, i], "right") + i * BINS for i in range(FIGURES)], 1) if len(figures) else np.empty((0, FIGURES), int)
        base = FIGURES * BINS
        return [np.concatenate([b, [base + self.pages[n] for n in ns if n in self.pages]]).astype(np.int64) for b, ns in zip(bins, names, strict=True)]

    def size(self, view: str) -> int:
        return len(self.words) if view == "text" else FIGURES * BINS + len(self.pages)

    def odds(self, trait: str, rows: dict[str, Rows]) -> np.ndarray:
        z = [self.views[trait, v].score(rows[v]) for v in VIEWS]
        return np.stack([*z, np.ones(len(z[0]))], 1) @ self.mix[trait]


class Trainer:
    """Views fitted to all labelled rows, and the scores of each row by views fitted to the other folds."""

    def __init__(self, sample: list[dict]):
        figures = np.array([r["figures"] for r in sample], float).reshape(-1, FIGURES)
        borders = np.quantile(figures, np.linspace(0, 1, BINS + 1)[1:-1], axis=0) if len(figures) else np.zeros((BINS - 1, FIGURES))
        ids = [np.frombuffer(r["words"], np.uint32) for r in sample]
        flat = np.concatenate([*ids, np.empty(0, np.uint32)])
        known, counts = np.unique(flat, return_counts=True)
        vocabulary = known[counts >= LEAST_DOCS]
        names = [page_names(r["source"], r["lang"], set(r["marks"])) for r in sample]
        seen: dict[str, int] = {}
        for n in (n for ns in names for n in ns):
            seen[n] = seen.get(n, 0) + 1
        pages = {n: i for i, n in enumerate(sorted(n for n, c in seen.items() if c >= LEAST_DOCS))}
        self.model = Model(borders, {int(v): i for i, v in enumerate(vocabulary)}, pages)
        at = np.searchsorted(vocabulary, flat)
        there = np.zeros(len(flat), bool)
        there[at < len(vocabulary)] = vocabulary[at[at < len(vocabulary)]] == flat[at < len(vocabulary)]
        text = Rows(at[there].astype(np.int64), np.concatenate([[0], np.cumsum(there)])[np.cumsum([0, *map(len, ids)])])
        self.rows = {"text": text, "page": Rows.of(self.model.page_features(figures, names))}
        fold = np.array([zlib.crc32(b"held%d" % (r["doc_id"] or 0)) % FOLDS for r in sample], int)
        self.y: dict[str, np.ndarray] = {}
        self.labelled: dict[str, np.ndarray] = {}
        #: By trait and view, in the order of the trait's labelled rows.
        self.held: dict[tuple[str, str], np.ndarray] = {}
        for trait in TRAITS:
            y = np.array([np.nan if r[trait] is None else float(r[trait] > 0) for r in sample])
            own = np.flatnonzero(~np.isnan(y))
            if any(len(np.unique(y[own[fold[own] != f]])) < 2 for f in range(FOLDS)):
                continue
            self.y[trait], self.labelled[trait] = y[own], own
            for v in VIEWS:
                size, rows = self.model.size(v), self.rows[v].take(own)
                self.held[trait, v] = np.zeros(len(own))
                for f in range(FOLDS):
                    others, mine = np.flatnonzero(fold[own] != f), np.flatnonzero(fold[own] == f)
                    self.held[trait, v][mine] = fit(rows.take(others), y[own[others]], size).score(rows.take(mine))
                self.model.views[trait, v] = fit(rows, y[own], size)
                self._calibrate(trait, v)
        self._combine()

    def _calibrate(self, trait: str, view: str) -> None:
        self.model.scale[trait, view] = calibrate([self.held[trait, view]], self.y[trait])

    def _mixed(self, trait: str, rows: np.ndarray) -> np.ndarray:
        """Factors of the views, none below zero, and the offset, fitted to some labelled rows."""
        scores, y, used = {v: self.held[trait, v][rows] for v in VIEWS}, self.y[trait][rows], list(VIEWS)
        while True:
            w = calibrate([scores[v] for v in used], y)
            if len(used) == 1 or w[:-1].min() > 0:
                return np.array([dict(zip(used, w, strict=False)).get(v, 0.0) for v in VIEWS] + [w[-1]])
            used.pop(int(w[:-1].argmin()))

    def _combine(self) -> None:
        for trait, y in self.y.items():
            every = np.arange(len(y))
            self.model.mix[trait] = self._mixed(trait, every)
            right = 0
            for half in (every % 2 == 0, every % 2 == 1):
                w = self._mixed(trait, every[half])
                z = w[0] * self.held[trait, "text"] + w[1] * self.held[trait, "page"] + w[2]
                right += ((z > 0) == (y > 0.5))[~half].sum()
            self.model.accuracy[trait] = float(right / max(len(y), 1))

    def exchange(self, sums: dict[tuple[str, str], tuple[np.ndarray, np.ndarray]]) -> bool:
        """Take up sums by (trait, learner): rows with each feature and all rows, of either class. Whether any helped."""
        helped = False
        for (trait, view), (there, rows) in sums.items():
            self.model.taught |= {(trait, view, c): int(rows[c]) for c in (0, 1)}
            if rows.min() < LEAST_DOCS:
                continue
            share = (there + 0.5) / (rows[:, None] + 1)
            expected = there.sum(0) * rows[1] / rows.sum()
            spread = expected * rows[0] / rows.sum() * (1 - there.sum(0) / rows.sum())
            telling = (there[1] - expected) ** 2 >= TELLING * np.maximum(spread, 1e-9)
            opinion = Linear(np.where(telling, np.log(share[1] / share[0]), 0.0))
            y, own = self.y[trait], self.model.views[trait, view]
            # The opinion's degree is fitted on one half of the labelled rows and must help on the other, both ways.
            halves = [np.arange(len(y)) % 2 == k for k in (0, 1)]
            if any(len(np.unique(y[h])) < 2 for h in halves):
                continue
            mine, more = self.held[trait, view], opinion.score(self.rows[view].take(self.labelled[trait]))
            gain = 0.0
            for fitted, held in (halves, halves[::-1]):
                one, two = calibrate([mine[fitted]], y[fitted]), calibrate([mine[fitted], more[fitted]], y[fitted])
                gain += log_loss(one[0] * mine[held] + one[1], y[held]) - log_loss(two[0] * mine[held] + two[1] * more[held] + two[2], y[held])
            w = calibrate([mine, more], y)
            if gain > 0 and w[0] > 0 and w[1] > 0:
                self.model.views[trait, view] = Linear(own.weights + w[1] / w[0] * opinion.weights, own.bias)
                self.held[trait, view] = mine + w[1] / w[0] * more
                self._calibrate(trait, view)
                helped = True
        self._combine()
        return helped


# -- Spark ------------------------------------------------------------------------------------


def _inputs(docs: DataFrame) -> list[Column]:
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    return [F.col("doc_id").cast("long").alias("doc_id"), text, row_key(docs).alias("row_key"), *[F.col(c).cast("string").alias(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in ("source", "lang")]]


def _share(column: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.lit("sample"), column.cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def clean_labels(labels: DataFrame) -> DataFrame:
    return labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"), F.max("toxic").cast("int").alias("toxic"))


def training_sample(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> list[dict]:
    """About ``labelled`` rows with labels, by hash of the id, as features."""
    clean = clean_labels(labels)
    rate = min(1.0, labelled / max(clean.count(), 1))
    chosen = clean.where(_share(F.col("doc_id")) < rate)  # rows of three numbers: bounded
    read = docs.select(*_inputs(docs)).where(F.col("doc_id").isNotNull() & (_share(F.col("doc_id")) < rate))
    schema = "doc_id long, words binary, marks array<binary>, figures array<double>, source string, lang string, quality int, toxic int"
    arrow = _arrow_schema(docs.sparkSession, schema)
    ship_package(docs.sparkSession)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                rows = []
                for r in batch.slice(at, SLICE).to_pylist():
                    words, seen, marks = words_in(r["text"])
                    rows.append((r["doc_id"], word_ids(seen).tobytes(), sorted(marks), layout(r["text"], words), r["source"], r["lang"], r["quality"], r["toxic"]))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    joined = read.join(F.broadcast(chosen), "doc_id")
    out = joined.select("doc_id", "text", "source", "lang", "quality", "toxic").mapInArrow(features, schema)
    return sorted((r.asDict() for r in out.toLocalIterator()), key=lambda r: (r["doc_id"], r["words"]))


def featured(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, row_key, text and page (numbers of the features that each row has in either view)."""
    schema = "doc_id long, row_key long, text array<int>, page array<int>"
    arrow = _arrow_schema(docs.sparkSession, schema)
    ship_package(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, place = known.value, {}
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE).to_pylist()
                if len(place) > REMEMBERED:
                    place.clear()
                lists, figures, names = [], [], []
                for r in part:
                    words, seen, marks = words_in(r["text"])
                    figures.append(layout(r["text"], words))
                    names.append(page_names(r["source"], r["lang"], marks))
                    mine = []
                    for w in seen:
                        if (i := place.get(w)) is None:
                            i = place[w] = model.words.get(zlib.crc32(w), -1)
                        if i >= 0:
                            mine.append(i)
                    lists.append(np.unique(np.array(mine, np.int32)))
                page = [p.astype(np.int32) for p in model.page_features(np.array(figures), names)]
                yield pa.RecordBatch.from_arrays([pa.array([r["doc_id"] for r in part], pa.int64()), pa.array([r["row_key"] for r in part], pa.int64()), pa.array(lists, arrow.field(2).type), pa.array(page, arrow.field(3).type)], schema=arrow)

    return docs.select(*_inputs(docs)).mapInArrow(rows, schema)


def _views(batch: pa.RecordBatch) -> dict[str, Rows]:
    out = {}
    for v in VIEWS:
        column = batch.column(batch.schema.get_field_index(v))
        start = column.offsets.to_numpy().astype(np.int64)
        out[v] = Rows(column.values.to_numpy()[: start[-1]].astype(np.int64)[start[0] :], start - start[0])
    return out


#: Partial sums that are added up in one task, by rounds.
FAN = 64


def sure_sums(rows: DataFrame, model: Model, sure: float = SURE) -> dict[tuple[str, str], tuple[np.ndarray, np.ndarray]]:
    """By (trait, learner): how many rows that the other view is sure of have each feature, and how many there are.

    Every task adds up its rows to vectors of a fixed size; vectors are added up FAN at a time.
    """
    schema = "part long, data binary"
    arrow = _arrow_schema(rows.sparkSession, schema)
    known = rows.sparkSession.sparkContext.broadcast(model)
    keys = [(t, v) for t in model.mix for v in VIEWS]
    sizes = [2 * (model.size(v) + 1) for _, v in keys]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        model, sums = known.value, [np.zeros((2, n // 2)) for n in sizes]
        for batch in batches:
            views = _views(batch)
            for (trait, learner), out in zip(keys, sums, strict=True):
                teacher = VIEWS[1 - VIEWS.index(learner)]
                factor, offset = model.scale[trait, teacher]
                p = sigmoid(factor * model.views[trait, teacher].score(views[teacher]) + offset)
                owner = np.repeat(np.arange(batch.num_rows), np.diff(views[learner].start))
                for c, chosen in enumerate((p < 1 - sure, p > sure)):
                    out[c, :-1] += np.bincount(views[learner].flat[chosen[owner]], minlength=out.shape[1] - 1)
                    out[c, -1] += chosen.sum()
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([np.concatenate([x.ravel() for x in sums]).tobytes()], pa.binary())], schema=arrow)

    def together(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py()) for x in group.column("data"))
        return pa.Table.from_arrays([pa.array([group.column("part")[0].as_py()]), pa.array([total.tobytes()], pa.binary())], schema=arrow)

    parts, n = rows.select("text", "page").mapInArrow(add, schema), rows.rdd.getNumPartitions()
    while n > 1:
        n = -(-n // FAN)
        parts = parts.groupBy(F.pmod("part", F.lit(n)).alias("to")).applyInArrow(together, schema)
    flat = np.sum([np.frombuffer(r.data) for r in parts.collect()], axis=0) if keys else np.zeros(0)  # one row
    out, at = {}, 0
    for key, size in zip(keys, sizes, strict=True):
        both = np.asarray(flat[at : at + size]).reshape(2, -1)
        out[key], at = (both[:, :-1], both[:, -1]), at + size
    return out


def score(rows: DataFrame, model: Model) -> DataFrame:
    """doc_id, row_key, quality_score, toxic_score and keep for each of ``rows`` (see featured)."""
    schema = "doc_id long, row_key long, quality_score double, toxic_score double, keep boolean"
    arrow = _arrow_schema(rows.sparkSession, schema)
    known = rows.sparkSession.sparkContext.broadcast(model)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = known.value
        for batch in batches:
            views, none = _views(batch), [None] * batch.num_rows
            p = {t: sigmoid(model.odds(t, views)).tolist() for t in model.mix}
            q, x = p.get("quality", none), p.get("toxic", none)
            keep = [(a is None or a >= LEAST_QUALITY) and (b is None or b < MOST_TOXIC) for a, b in zip(q, x, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(q, pa.float64()), pa.array(x, pa.float64()), pa.array(keep, pa.bool_())], schema=arrow)

    return rows.select("doc_id", "row_key", "text", "page").mapInArrow(scores, schema)


def co_trained(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, Model]:
    """All rows' features, and the model after ``rounds`` of exchange, or fewer if nothing helps any more."""
    trainer = Trainer(training_sample(docs, labels))
    rows = written(featured(docs, trainer.model), "features")
    if trainer.model.mix:
        labelled = checkpointed(clean_labels(labels).select(F.col("doc_id").alias("__id")))
        for _ in range(rounds):
            if not trainer.exchange(sure_sums(only_ids(rows, labelled, keep=False), trainer.model)):
                break
    return rows, trainer.model


def scored_rows(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    return score(*co_trained(docs, labels, rounds))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scored_rows(docs, labels).drop("row_key")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
