"""Language identification in two steps (operator 3).

Texts become counts of hashed letter sequences (one to three characters of the lower-cased
text, everything but letters being a space), damped and scaled to length one. Languages are
joined to families by the likeness of their mean vectors. A linear support vector machine
for each pair of families votes for the family, then one for each pair of its languages
votes for the language. The score is the product of the two winners' least certainty.

The machines are fitted on a bounded sample: about ``sample`` labelled rows in all, shared
out evenly among the languages; prediction reads whole texts.

Cases: a text that is null or has no letter is ``und`` with score 0, and so is every text
if there are no labelled rows; one learned language is always predicted with score 1; rows
that repeat an id, or have none, each get a row (a null id isn't held out); an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tessel.llm.common import columns, plain, short_batches

UNKNOWN = "und"
FEATURES = 2048
SAMPLE = 4000
#: Steepness of the certainty as a function of a machine's margin.
STEEPNESS = 3.0


def _letters() -> np.ndarray:
    table = np.arange(0x250, dtype=np.uint32)
    table[[not chr(c).isalpha() for c in range(0x250)]] = 32
    return table


_LATIN = _letters()
_M = [np.uint32(x) for x in (2654435761, 2246822519, 3266489917)]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def features(text: str, size: int = FEATURES) -> np.ndarray:
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype="<u4")
    codes = np.where(codes < 0x250, _LATIN[np.minimum(codes, 0x24F)], codes)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
    codes = codes[keep]
    one = codes * _M[0]
    two = (one[:-1] >> np.uint32(3)) + codes[1:] * _M[1]
    three = (two[:-1] >> np.uint32(5)) + codes[2:] * _M[2]
    counts = np.zeros(size, np.int64)
    for h in (one, two, three):
        counts += np.bincount((h ^ (h >> np.uint32(15))) % np.uint32(size), minlength=size)
    damped = np.sqrt(counts)
    return (damped / np.sqrt((damped * damped).sum())).astype(np.float32)


def fit_machine(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 30) -> np.ndarray:
    """Weights (the last is the bias) of a linear SVM by dual coordinate descent; y is -1 or 1."""
    w, alpha = np.zeros(x.shape[1] + 1), np.zeros(len(x))
    data = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    norms = np.einsum("ij,ij->i", data, data)
    rng = np.random.default_rng(3)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(x)):
            slope = y[i] * (data[i] @ w) - 1 + alpha[i] / (2 * cost)
            new = max(0.0, alpha[i] - slope / (norms[i] + 1 / (2 * cost)))
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * data[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


@dataclass
class Voting:
    """One-versus-one machines over some classes."""

    classes: list
    pairs: list[tuple[int, int]]
    weights: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, labels: np.ndarray, classes: list) -> Voting:
        pairs, weights = list(combinations(range(len(classes)), 2)), []
        for a, b in pairs:
            at = np.flatnonzero((labels == a) | (labels == b))
            weights.append(fit_machine(x[at], np.where(labels[at] == a, 1.0, -1.0)))
        return cls(classes, pairs, np.array(weights).reshape(len(pairs), x.shape[1] + 1))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the class with most votes (then with the largest margins), and its least certainty."""
        n = len(self.classes)
        if n == 1:
            return np.zeros(len(x), np.int64), np.ones(len(x))
        margins = x @ self.weights[:, :-1].T + self.weights[:, -1]
        votes, worst = np.zeros((len(x), n)), np.full((len(x), n), np.inf)
        for k, (a, b) in enumerate(self.pairs):
            m = margins[:, k]
            votes[:, a] += (m > 0) + np.tanh(m) / (4 * n)
            votes[:, b] += (m <= 0) - np.tanh(m) / (4 * n)
            worst[:, a] = np.minimum(worst[:, a], m)
            worst[:, b] = np.minimum(worst[:, b], -m)
        best = votes.argmax(axis=1)
        return best, 1 / (1 + np.exp(-STEEPNESS * worst[np.arange(len(x)), best]))


@dataclass
class Model:
    families: Voting
    languages: list[Voting]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        out, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        at = np.array([k for k, t in enumerate(texts) if has_letter(t)], dtype=np.int64)
        if not len(at):
            return out, scores
        x = np.stack([features(texts[k]) for k in at])
        family, sure = self.families.predict(x)
        for f in np.unique(family).tolist():
            some = np.flatnonzero(family == f)
            which, inner = self.languages[f].predict(x[some])
            for k, w, s in zip(at[some].tolist(), which.tolist(), (sure[some] * inner).tolist()):
                out[k], scores[k] = self.languages[f].classes[w], s
        return out, scores


def group_families(means: np.ndarray) -> list[list[int]]:
    """Merges the two most alike groups until about the square root of the classes is left."""
    groups = [[k] for k in range(len(means))]
    centre = means - means.mean(axis=0)
    centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-12)
    alike = centre @ centre.T
    while len(groups) > max(1, round(len(means) ** 0.5)):
        a, b = max(combinations(range(len(groups)), 2), key=lambda p: alike[np.ix_(groups[p[0]], groups[p[1]])].mean())
        groups[a] = sorted(groups[a] + groups.pop(b))
    return groups


def fit(x: np.ndarray, langs: list[str]) -> Model | None:
    if not len(x):
        return None
    names = sorted(set(langs))
    labels = np.array([names.index(v) for v in langs])
    groups = group_families(np.stack([x[labels == k].mean(axis=0) for k in range(len(names))]))
    of = np.array([next(g for g, members in enumerate(groups) if k in members) for k in range(len(names))])
    inner = []
    for g in groups:
        at = np.flatnonzero(np.isin(labels, g))
        inner.append(Voting.fit(x[at], np.array([g.index(k) for k in labels[at]]), [names[k] for k in g]))
    return Model(Voting.fit(x, of[labels], list(range(len(groups)))), inner)


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def learn(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Fits a model on labelled rows that aren't held out, about ``sample`` of them."""
    docs = columns(docs, doc_id=id_col, text=text_col, lang=lang_col)
    id_col, text_col, lang_col = "doc_id", "text", "lang"
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col))
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}  # a row for each language
    if not counts:
        return None
    share = sample / len(counts)
    taken = F.lit(False)
    for lang, n in counts.items():
        part = F.pmod(F.xxhash64(F.lit("sample"), F.col(id_col)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, share / n)) + 1
        taken = taken | ((F.col(lang_col) == lang) & part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [(lang, key, features(t).tobytes()) for lang, t, key in zip(*(batch.column(k).to_pylist() for k in range(3))) if has_letter(t)]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in kept], pa.string()), pa.array([k[1] for k in kept], pa.int64()), pa.array([k[2] for k in kept], pa.binary())], names=["lang", "key", "x"])

    short_batches(docs.sparkSession)
    found = rows.where(taken).select(F.col(lang_col).cast("string"), F.col(text_col), F.xxhash64(text_col, id_col)).mapInArrow(run, "lang string, key long, x binary").toArrow()
    langs, keys = found.column(0).to_pylist(), found.column(1).to_pylist()
    order = sorted(range(len(langs)), key=lambda k: (langs[k], keys[k]))
    x, values = np.empty((len(order), FEATURES), np.float32), found.column(2)
    for row, k in enumerate(order):
        x[row] = np.frombuffer(values[k].as_buffer(), np.float32)
    del found, values
    return fit(x, [langs[k] for k in order])


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; or, with keep, all columns of docs (named as by ``plain``) and the last two."""

    def predict(texts: list[str | None]) -> list[pa.Array]:
        lang, score = model.predict(texts) if model else ([UNKNOWN] * len(texts), [0.0] * len(texts))
        return [pa.array(lang, pa.string()), pa.array(score, pa.float64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            head = batch.columns if keep else batch.columns[:2]
            yield pa.RecordBatch.from_arrays([*head, *predict(batch.column(text_at).to_pylist())], names=names)

    short_batches(docs.sparkSession)
    docs, _ = plain(docs, doc_id=id_col, text=text_col)
    if keep:
        text_at, names = docs.columns.index("text"), [*docs.columns, "lang_pred", "score"]
        schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
        return docs.mapInArrow(run, schema)
    text_at, names = 2, ["doc_id", "held_out", "lang_pred", "score"]
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
