"""Operator 3: a toxicity classifier that is penalised for heeding who is spoken of.

Logistic regression over the words of a text and their beginnings. Besides the labels, the loss looks at
counterfactuals: in labelled sentences that name a group, the name is swapped for those of other groups,
and the squared change of the sentence's score is a penalty. A group's name can so add to a score only
what every other group's name adds.

The model is fitted on a bounded sample of labelled rows (``MAX_LABELLED``, by a hash of the id) with
the ``MAX_FEATURES`` features that tell the labels apart best; all texts are scored in one pass.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from entitlekit.llm.common import U64, checkpoint, find_words, mix, slices, span_hashes, text_buffer

MAX_LABELLED, MAX_FEATURES, LEAST_DOCS = 20_000, 6_000, 4
PREFIXES = (4, 5, 6)  # bytes
L2, COUNTERFACTUAL, STEPS, RATE = 3e-4, 1.0, 400, 0.3
FOLDS = 5

# Names of groups, by kind; a name is swapped for the others of its kind and language.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "african", "latino", "european"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer"),
    ("immigrants", "refugees", "foreigners", "natives", "citizens"),
    ("young", "old", "elderly", "disabled", "blind", "deaf"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("christen", "muslime", "juden", "hindus", "buddhisten"),
    ("femmes", "hommes", "filles", "garçons"),
    ("chrétiens", "musulmans", "juifs", "hindous", "bouddhistes"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("cristianos", "musulmanes", "judíos", "hindúes", "budistas"),
)
SWAPS = {term: [t for t in terms if t != term] for terms in IDENTITY_TERMS for term in terms}
NAMED = re.compile(r"(?<!\w)(" + "|".join(sorted(SWAPS, key=len, reverse=True)) + r")(?!\w)", re.I)
SENTENCE = re.compile(r"[^.!?\n]+")

IN_WORD = np.zeros(256, bool)
IN_WORD[97:123] = IN_WORD[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(names, rows) of the words and word beginnings of texts, repeats included."""
    data = LOWER[data]
    starts, ends, bounds = find_words(data, offsets, IN_WORD)
    rows = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    names, owners = [], []
    for lo in range(0, len(starts), 100_000):
        a, b, r = starts[lo : lo + 100_000], ends[lo : lo + 100_000], rows[lo : lo + 100_000]
        part = data[a[0] : b[-1]]
        names.append(mix(span_hashes(part, a - a[0], b - a[0]), 3))
        owners.append(r)
        for k in PREFIXES:
            long = b - a >= k
            names.append(mix(span_hashes(part, a[long] - a[0], a[long] - a[0] + k), 5))
            owners.append(r[long])
    if not names:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    return np.concatenate(names), np.concatenate(owners)


@dataclass(frozen=True)
class Model:
    """Sorted feature names, their weights, and the score of a text without any."""

    names: np.ndarray
    weights: np.ndarray
    bias: float

    def active(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, feature) of the known features of each text, each once."""
        if not len(self.names):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        names, rows = features(data, offsets)
        at = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
        hit = self.names[at] == names
        pairs = np.unique(rows[hit] * len(self.names) + at[hit])
        return pairs // len(self.names), pairs % len(self.names)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        rows, at = self.active(data, offsets)
        return _sigmoid(self.bias + np.bincount(rows, self.weights[at], minlength=len(offsets) - 1))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of each label with each feature, summed per task."""
    for batch in (part for batch in batches for part in slices(batch, "text")):
        names, rows = features(*text_buffer(batch, "text"))
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(bool)
        order = np.lexsort((names, rows))
        names, rows = names[order], rows[order]
        if not len(names):
            continue
        first = np.concatenate([[True], (names[1:] != names[:-1]) | (rows[1:] != rows[:-1])])
        names, hit = names[first], toxic[rows[first]]
        unique, at = np.unique(names, return_inverse=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(unique.view(np.int64)), pa.array(np.bincount(at, hit, len(unique)).astype(np.int64)), pa.array(np.bincount(at, ~hit, len(unique)).astype(np.int64))],
            names=["name", "with_toxic", "with_clean"],
        )


def counterfactuals(text: str) -> Iterator[tuple[str, str]]:
    """Each sentence of ``text`` that names a group, with the same sentence about each other group of its kind.

    Of several names in a sentence all are swapped at once, those of smaller kinds in turn.
    """
    for m in SENTENCE.finditer(text):
        turns = max((len(SWAPS[t.lower()]) for t in NAMED.findall(m[0])), default=0)
        for turn in range(turns):
            yield m[0], NAMED.sub(lambda t: (others := SWAPS[t[0].lower()])[turn % len(others)], m[0])


def _examples(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """The known features of each text, and what swapping groups in its sentences changes."""
    for batch in (part for batch in batches for part in slices(batch, "text")):
        data, offsets = text_buffer(batch, "text")
        rows, at = model.active(data, offsets)
        bounds = np.searchsorted(rows, np.arange(batch.num_rows + 1))
        changes = []
        for text in batch.column("text").to_pylist():
            pairs = [t for pair in counterfactuals(text) for t in pair] if NAMED.search(text) else []
            own = [[] for _ in pairs[::2]]
            if pairs:
                r, f = model.active(*text_buffer(pa.RecordBatch.from_arrays([pa.array(pairs)], names=["text"]), "text"))
                for k in range(len(own)):
                    gone, new = set(f[r == 2 * k].tolist()), set(f[r == 2 * k + 1].tolist())
                    own[k] = [-x - 1 for x in sorted(gone - new)] + [x + 1 for x in sorted(new - gone)]
            changes.append([c for c in own if c])
        lists = [at[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(lists, pa.list_(pa.int32())), pa.array(changes, pa.list_(pa.list_(pa.int32())))], names=["toxic", "active", "changes"])


def _sparse(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in lists], np.int64)
    return np.repeat(np.arange(len(lists)), sizes), np.array([v for x in lists for v in x], np.int64)


def fit(rows: list, names: np.ndarray, swaps: list) -> Model:
    """Weights by gradient steps on the log loss, the counterfactual penalty and a ridge.

    ``rows`` have toxic and active features, ``swaps`` the different changes that swaps make, with their
    counts. The rarer toxic rows weigh more, by the root of how much rarer they are.
    """
    toxic = np.array([r["toxic"] for r in rows], float)
    row, at = _sparse([r["active"] for r in rows])
    change_row, change = _sparse([s["change"] for s in swaps])
    n, uses = len(rows), np.array([s["uses"] for s in swaps], float)
    sign, changed = np.sign(change), np.abs(change) - 1
    weights, bias = np.zeros(len(names)), float(np.log((toxic.sum() + 1) / (n - toxic.sum() + 1)))
    balance = np.where(toxic > 0, np.sqrt(max(1.0, (n - toxic.sum()) / max(1.0, toxic.sum()))), 1.0)
    square, bias_square = np.full(len(names), 1e-8), 1e-8
    for _ in range(STEPS):
        residual = (_sigmoid(bias + np.bincount(row, weights[at], minlength=n)) - toxic) * balance
        gradient = np.bincount(at, residual[row], minlength=len(names)) / n + L2 * weights
        if len(swaps):
            moved = uses / uses.sum() * np.bincount(change_row, sign * weights[changed], minlength=len(swaps))
            gradient += 2 * COUNTERFACTUAL * np.bincount(changed, sign * moved[change_row], minlength=len(names))
        square += gradient**2
        weights -= RATE * gradient / np.sqrt(square)
        step = residual.mean()
        bias_square += step**2
        bias -= RATE * step / np.sqrt(bias_square)
    return Model(names, weights, bias)


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """A model of ``labels.toxic`` from the texts of at most ``max_labelled`` labelled rows."""
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    )
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)  # at most 16 bytes a row
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).join(F.broadcast(sample), "doc_id")
    texts = texts.select("text", "toxic")
    share = texts.agg(F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("all")).first()
    if not share["all"]:
        return Model(np.zeros(0, U64), np.zeros(0), -5.0)
    toxic, clean = max(1, share["toxic"]), max(1, share["all"] - share["toxic"])
    counted = texts.mapInArrow(_count, "name long, with_toxic long, with_clean long").groupBy("name").agg(
        F.sum("with_toxic").alias("a"), F.sum("with_clean").alias("b"),
    )
    rate = (F.col("a") + F.col("b") + 1.0) / (toxic + clean + 2)
    apart = F.abs(F.col("a") / toxic - F.col("b") / clean) / F.sqrt(rate * (1 - rate) * (1 / toxic + 1 / clean))
    best = counted.where(F.col("a") + F.col("b") >= LEAST_DOCS).orderBy(apart.desc(), "name").limit(MAX_FEATURES)
    names = np.sort(np.array([r["name"] for r in best.select("name").collect()], np.int64).view(U64))
    blank = Model(names, np.zeros(len(names)), 0.0)
    examples = checkpoint(texts.mapInArrow(lambda b: _examples(b, blank), "toxic int, active array<int>, changes array<array<int>>"))
    # what a swap changes is mostly its two names, so the different changes are few
    swaps = examples.select(F.explode("changes").alias("change")).groupBy("change").agg(F.count(F.lit(1)).alias("uses"))
    return fit(examples.select("toxic", "active").collect(), names, sorted(swaps.collect()))


def _score(batches: Iterator[pa.RecordBatch], model: Model, name: str = "score") -> Iterator[pa.RecordBatch]:
    for batch in (part for batch in batches for part in slices(batch, "text")):
        scores = model.score(*text_buffer(batch, "text"))
        yield batch.append_column(name, pa.array(scores))


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text, score, predicted) for every row of ``docs``: score is the probability of toxic.

    ``docs`` has doc_id and text; other columns are ignored. A null or empty text scores what a text
    without known words does; repeated rows score alike; an empty table gives an empty table.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    scored = texts.mapInArrow(lambda b: _score(b, model), "doc_id long, text string, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def with_score(docs: DataFrame, model: Model, name: str) -> DataFrame:
    """``docs`` as it is, with the score of each row in a column ``name``, which it must not have."""
    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])
    return docs.mapInArrow(lambda b: _score(b, model, name), schema)


def held_out(doc_id="doc_id"):
    """Whether a row is kept from learning: its id's checksum is divisible by ``FOLDS``."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))
