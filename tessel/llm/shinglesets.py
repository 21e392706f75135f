"""Near copies by SimHash fingerprints and the exact Jaccard similarity of sets of word shingles (the pipeline's stage).

The vantage-point trees of operator 8 give the pairs whose fingerprints of five-word shingles
differ in a few bits. A pair at a similarity of 0.8 differs in 15 % of the bits, which is beyond
what trees can prune, so the other pairs are met by their rarest shingles, where fingerprints of
128 bits refute those that can't be similar. All pairs are settled on the whole sets.

Two sets of similarity t share a shingle among the first ``n - ceil(t n) + 1`` of each, whatever
order all sets are sorted in. The order used puts shingles last that are common in a bounded
sample; it sets only the number of candidates, never the result. Candidates are settled on the
whole sets, whose shingles are 64-bit hashes. A pair that is similar enough is refuted by its fingerprints with a
chance below 1e-5 (see ``most_bits``).

First each set meets only one that shares a shingle: among the middles of its shingles' groups (the
sets whose fingerprints are nearest to their group's majority) the nearest. Then those of one
shingle meet that aren't joined yet, within the task that holds them, and only what they join
leaves it, so no pairs are written. They meet twice: with the parities of their sets, a sixteenth
of the bytes or so, which refute nearly all pairs that aren't similar and none that is; and those
that are left with the whole sets. Shingles whose holders have the same first one meet in one
place, so a set goes to few places however many shingles it shares. Copies are one
set from the start.

The documents lie in slots, as for operator 7, so texts aren't shuffled when sets are asked for.

Cases: null and empty texts, and texts of white space, are the empty set and copies of each
other; texts of fewer words than a shingle are one shingle; rows that repeat an id are one node
of the components; rows without an id are left out; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import Bucketed, Written, columns, drawn_by_hash, settings, short_batches
from tessel.llm.components import components
from tessel.llm.simhash import Union, majority, near_links
from tessel.llm.substrings import AS_THEY_LIE, bucket_count, laid_out

SHINGLE = 5
SIMILARITY = 0.8
#: Documents that the order is drawn from, and in how many of them a shingle is common.
SAMPLE, COMMON = 8192, 8
#: Rows of a group in which shingles meet.
GROUP = 200_000
#: Bits of a set's parity for each of its shingles, at least.
PARITY = 2


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes; bytes.lower and bytes.split know ASCII only, as for fingerprints."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = xxhash.xxh64_intdigest
    whole = zip(*(words[k:] for k in range(size))) if len(words) >= size else [words]
    return np.unique(np.array([h(b" ".join(w), 42) for w in whole], dtype=np.uint64))


def marks(found: np.ndarray) -> tuple[int, int]:
    """The set's fingerprint of 128 bits, as two signed longs; the first is what the trees compare."""
    if not len(found):
        return 0, 0
    other = (found ^ (found >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    pair = np.array([majority(found), majority(other ^ (other >> np.uint64(32)))], dtype=np.uint64)
    return tuple(pair.view(np.int64).tolist())


def parity(found: np.ndarray) -> bytes:
    """A bit for each remainder of the shingles by a power of two: whether an odd number of them has it.

    Two sets' bits differ in no more places than there are shingles that one of them has alone.
    """
    bits = max(64, 1 << (PARITY * len(found) - 1).bit_length()) if len(found) else 64
    odd = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


class Parities:
    """Parities of sets, by the number of their words of 64 bits."""

    def __init__(self, held: list[bytes]):
        self.size = np.array([len(b) // 8 for b in held], np.int64)
        self.at, self.rows = np.zeros(len(held), np.int64), {}
        for s in np.unique(self.size).tolist():
            same = np.flatnonzero(self.size == s)
            self.at[same] = np.arange(len(same))
            self.rows[s] = np.frombuffer(b"".join(held[k] for k in same.tolist()), np.uint64).reshape(-1, s)

    @staticmethod
    def _folded(rows: np.ndarray, words: int) -> np.ndarray:
        while rows.shape[-1] > words:
            half = rows.shape[-1] // 2
            rows = rows[..., :half] ^ rows[..., half:]
        return rows

    def apart(self, x: int, y: np.ndarray) -> np.ndarray:
        """For each of y the least number of shingles that only one of the two sets has."""
        out = np.zeros(len(y), np.int64)
        own = self.rows[int(self.size[x])][self.at[x]]
        for s in np.unique(self.size[y]).tolist():
            same = self.size[y] == s
            words = min(s, len(own))
            out[same] = np.bitwise_count(self._folded(self.rows[s][self.at[y[same]]], words) ^ self._folded(own, words)).sum(axis=1)
        return out


def most_apart(n, m, threshold: float):
    """Shingles that only one of two sets of these sizes has, if their similarity is at least the threshold."""
    return (n + m) * (1 - threshold) / (1 + threshold) + 1e-6


def most_bits(threshold: float) -> int:
    """Bits of 128 in which two sets of this similarity hardly ever differ more.

    Their vectors enclose an angle whose cosine is 2 t / (1 + t) at least. Small sets have no normal
    sums, which is worth a quarter more of it; 4.5 standard deviations are added.
    """
    p = min(0.5, 1.25 * np.arccos(2 * threshold / (1 + threshold)) / np.pi)
    return int(128 * p + 4.5 * np.sqrt(128 * p * (1 - p)))


def head(found: np.ndarray, common: np.ndarray, counts: np.ndarray, threshold: float) -> np.ndarray:
    """The shingles of which two sets of at least this similarity share one, in the common order."""
    n = len(found)
    rank = np.zeros(n, np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, found), len(common) - 1)
        rank = np.where(common[at] == found, counts[at], 0)
    return found[np.lexsort((found, rank))][: n - int(np.ceil(threshold * n - 1e-9)) + 1]


def _common(rows: DataFrame, shingle: int, sample: int) -> tuple[np.ndarray, np.ndarray]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(1).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingles(text, shingle).view(np.int64))], names=["token"])

    drawn = rows.where(drawn_by_hash(F.col("doc_id"), sample, rows.count()))
    found = drawn.mapInArrow(run, "token long").groupBy("token").count().where(F.col("count") >= COMMON).toPandas()
    tokens = found["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], found["count"].to_numpy(np.int64)[order]


def _heads(rows: DataFrame, shingle: int, threshold: float, sample: int) -> DataFrame:
    common, counts = _common(rows, shingle, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                found = shingles(text, shingle)
                key = xxhash.xxh128_digest(found.tobytes(), 42)
                k1, k2 = np.frombuffer(key, np.int64).tolist()
                out.append((k1, k2, len(found), *marks(found), head(found, common, counts, threshold).view(np.int64)))
            k1, k2, n, f1, f2, heads = zip(*out) if out else ((), (), (), (), (), ())
            longs = [pa.array(c, pa.int64()) for c in (k1, k2, f1, f2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(2), batch.column(0), *longs, pa.array(n, pa.int32()), pa.array(list(heads), pa.list_(pa.int64()))], names=["slot", "doc_id", "k1", "k2", "f1", "f2", "n", "head"]
            )

    return rows.mapInArrow(run, "slot int, doc_id long, k1 long, k2 long, f1 long, f2 long, n int, head array<long>")


def shared(sets: DataFrame, total: int) -> DataFrame:
    """token, rep: the heads' shingles, about total ones, that more than one set has in its head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        whole = pa.Table.from_batches(held)
        token = whole.column(0).to_numpy()
        order = np.argsort(token, kind="stable")
        same = token[order][1:] == token[order][:-1]
        keep = np.zeros(len(token), bool)
        keep[order] = np.r_[False, same] | np.r_[same, False]
        yield from whole.filter(pa.array(keep)).to_batches()

    short_batches(sets.sparkSession, 20_000)
    rows = sets.select(F.explode("head").alias("token"), "rep")
    return rows.repartition(total // GROUP + 1, "token").mapInArrow(run, "token long, rep long")


def fingerprint_pairs(sets: DataFrame) -> DataFrame:
    """a, b: ids of sets whose first 64 bits are the same, or linked by the trees; sets: rep, f1."""
    classes = Written(sets.groupBy(F.col("f1").alias("fp")).agg(F.min("rep").alias("rep")), "set-classes", narrow=True).df
    same = sets.join(classes.withColumnRenamed("rep", "a"), F.col("f1") == F.col("fp")).where("a <> rep").select("a", F.col("rep").alias("b"))
    return near_links(classes).unionByName(same).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def middles(f1: np.ndarray, f2: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of each group of consecutive rows the first one whose fingerprint is nearest to the majority's."""
    far = np.zeros(len(f1), np.int64)
    for f in (f1, f2):
        for bit in range(64):
            ones = (f >> np.uint64(bit)) & np.uint64(1)
            major = 2 * np.add.reduceat(ones, first) > size.astype(np.uint64)
            far += ones.astype(bool) != np.repeat(major, size)
    return np.lexsort((far, np.repeat(np.arange(len(first)), size)))[first]


class Group:
    """Rows of some shingles, those of one shingle next to each other: what two sets that meet there can have."""

    def __init__(self, pdf: pd.DataFrame, threshold: float, band: bool = False):
        n = pdf["n"].to_numpy()
        # Only sets of sizes that differ by less than this can be similar.
        self.band = np.floor(np.log(n) / -np.log(threshold)).astype(np.int64) if band else np.zeros(len(pdf), np.int64)
        order = np.lexsort((pdf["rep"].to_numpy(), self.band, pdf["token"].to_numpy()))
        token, self.rep, self.comp, self.n = (pdf[c].to_numpy().astype(np.int64)[order] for c in ("token", "rep", "comp", "n"))
        self.f1, self.f2 = (pdf[c].to_numpy().astype(np.int64)[order].view(np.uint64) for c in ("f1", "f2"))
        self.token, self.band, self.threshold, self.most = token, self.band[order], threshold, most_bits(threshold)
        self.first = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (self.band[1:] != self.band[:-1])])
        self.size = np.diff(np.r_[self.first, len(token)])

    def far(self, x, y) -> np.ndarray:
        return np.bitwise_count(self.f1[x] ^ self.f1[y]).astype(np.int16) + np.bitwise_count(self.f2[x] ^ self.f2[y])

    def may_link(self, x, y) -> np.ndarray:
        sized = np.minimum(self.n[y], self.n[x]) >= self.threshold * np.maximum(self.n[y], self.n[x]) - 1e-9
        return (self.comp[y] != self.comp[x]) & sized & (self.far(x, y) <= self.most)


def grouped(rows: DataFrame):
    short_batches(rows.sparkSession, 20_000)
    return rows.withColumn("group", F.pmod(F.xxhash64("token"), F.lit(rows.count() // GROUP + 1))).groupBy("group")


def star_pairs(rows: DataFrame, threshold: float) -> DataFrame:
    """a, b: each set and the nearest middle of its shingles' groups; rows: token, rep, n, comp, f1, f2."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g = Group(pdf, threshold, band=True)
        lead = np.repeat(middles(g.f1, g.f2, g.first, g.size), g.size)
        far = g.far(np.arange(len(lead)), lead)
        keep = np.flatnonzero((g.rep != g.rep[lead]) & (far <= g.most))
        keep = keep[np.lexsort((g.rep[lead[keep]], far[keep], g.rep[keep]))]
        keep = keep[np.r_[True, g.rep[keep][1:] != g.rep[keep][:-1]]] if len(keep) else keep
        return pd.DataFrame({"a": g.rep[lead[keep]], "b": g.rep[keep]}, dtype=np.int64)

    found = grouped(rows).applyInPandas(run, "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def unsettled(rows: DataFrame, threshold: float) -> DataFrame:
    """The columns of rows and lead: sets that meet one of another component there which may be similar; lead: the first of those that meet."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g = Group(pdf, threshold)
        hit = np.zeros(len(g.rep), bool)
        mixed = np.minimum.reduceat(g.comp, g.first) != np.maximum.reduceat(g.comp, g.first)
        for start, many in zip(g.first[mixed].tolist(), g.size[mixed].tolist()):
            for x in range(start, start + many - 1):
                y = np.arange(x + 1, start + many)
                y = y[g.may_link(x, y)]
                if len(y):
                    hit[x] = True
                    hit[y] = True
        lead = np.repeat(np.minimum.reduceat(np.where(hit, g.rep, np.iinfo(np.int64).max), g.first), g.size)
        found = {c: getattr(g, c)[hit] for c in ("token", "rep", "n", "comp")} | {c: getattr(g, c)[hit].view(np.int64) for c in ("f1", "f2")}
        return pd.DataFrame(found | {"lead": lead[hit]}, dtype=np.int64)

    return grouped(rows).applyInPandas(run, "token long, rep long, n long, comp long, f1 long, f2 long, lead long")


class Meeting:
    """Sets with the shingles they hold at one place."""

    def __init__(self, pdf: pd.DataFrame, threshold: float):
        tokens = pdf["held"].to_list()
        docs = pdf[["rep", "n", "comp", "f1", "f2"]].reset_index(drop=True).assign(doc=np.arange(len(pdf)), token=0)
        spread = docs.loc[np.repeat(docs.index, [len(t) for t in tokens])].assign(token=np.concatenate(tokens))
        self.group = Group(spread, threshold)
        self.doc = spread["doc"].to_numpy()[np.lexsort((spread["rep"].to_numpy(), np.zeros(len(spread)), spread["token"].to_numpy()))]

    def __iter__(self) -> Iterator[tuple[int, np.ndarray]]:
        """Each set, and the later ones of other components that it shares a shingle with and may link to."""
        g, doc = self.group, self.doc
        segment = np.repeat(np.arange(len(g.first)), g.size)
        places: dict[int, list[int]] = {}
        for at, d in enumerate(doc.tolist()):
            places.setdefault(d, []).append(at)
        for d, spots in places.items():
            near = np.unique(doc[np.concatenate([np.arange(at + 1, g.first[segment[at]] + g.size[segment[at]]) for at in spots])])
            if len(near):
                one = np.array([places[k][0] for k in near.tolist()])
                near = near[g.may_link(spots[0], one)]
                if len(near):
                    yield d, near


def unrefuted(left: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """place, rep, n, comp, f1, f2, held: the sets and shingles of ``unsettled`` at the places where they meet one whose parity allows that it is similar."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        many, parities = pdf["many"].to_numpy().astype(np.int64), Parities(pdf["parity"].to_list())
        hit = np.zeros(len(pdf), bool)
        for d, near in Meeting(pdf, threshold):
            near = near[parities.apart(d, near) <= most_apart(many[d], many[near], threshold)]
            if len(near):
                hit[d] = True
                hit[near] = True
        return pdf.loc[hit, ["place", "rep", "n", "comp", "f1", "f2", "held"]]

    short_batches(left.sparkSession, 20_000)
    placed = left.withColumn("place", F.pmod(F.xxhash64("lead"), F.lit(left.count() // GROUP + 1)))
    once = placed.groupBy("place", "rep", "n", "comp", "f1", "f2").agg(F.collect_list("token").alias("held"))
    known = once.join(sets.select(F.col("id").alias("rep"), "many", "parity"), "rep")
    return known.groupBy("place").applyInPandas(run, "place long, rep long, n long, comp long, f1 long, f2 long, held array<long>")


def joined_sets(sets: DataFrame, left: DataFrame, threshold: float) -> DataFrame:
    """a, b: components that similar sets join; left: what ``unrefuted`` gives. Sets meet at their place, and no pair leaves it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = [np.asarray(t, np.int64) for t in pdf["tokens"]]
        names, comp = np.unique(pdf["comp"].to_numpy(), return_inverse=True)
        union = Union(len(names))
        for d, near in Meeting(pdf, threshold):
            roots = union.roots()
            for k in near[roots[comp[near]] != roots[comp[d]]].tolist():
                both = len(np.intersect1d(sets[d], sets[k], assume_unique=True))
                if both >= threshold * (len(sets[d]) + len(sets[k]) - both) - 1e-9:
                    union.join(comp[[d]], comp[[k]])
        roots = union.roots()
        moved = np.flatnonzero(roots != np.arange(len(names)))
        return pd.DataFrame({"a": names[roots[moved]], "b": names[moved]}, dtype=np.int64)

    whole = left.join(sets.select(F.col("id").alias("rep"), "tokens"), "rep")
    return Written(whole.groupBy("place").applyInPandas(run, "a long, b long"), "joined-sets", narrow=True).df


def _of_sets(rows: DataFrame, ids: DataFrame, prints: DataFrame, shingle: int, name: str, whole: bool) -> Written:
    """id, and the tokens of these documents' sets, or else how many they are and their parity; the texts are looked up in their slots."""
    schema = "id long, tokens array<long>" if whole else "id long, many int, parity binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t, shingle) for t in batch.column(1).to_pylist()]
            if whole:
                made = {"tokens": pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))}
            else:
                made = {"many": pa.array([len(x) for x in found], pa.int32()), "parity": pa.array([parity(x) for x in found], pa.binary())}
            yield pa.RecordBatch.from_arrays([batch.column(0), *made.values()], names=["id", *made])

    spark = rows.sparkSession
    short_batches(spark)
    slots = prints.groupBy(F.col("rep").alias("id")).agg(F.min("slot").alias("slot"))
    wanted = Written(ids.join(slots, "id").select("slot", F.col("id").alias("doc_id")), "candidates", narrow=True).df
    with settings(spark, **AS_THEY_LIE):
        texts = rows.join(wanted.hint("shuffle_hash"), ["slot", "doc_id"]).dropDuplicates(["slot", "doc_id"])
        return Written(texts.select("doc_id", "text").mapInArrow(run, schema), name)


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()


def settled(rows: DataFrame, pairs: DataFrame, prints: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """The pairs whose whole sets are similar; parities refute most of the others before sets move."""

    def allowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y, p, q = (batch.column(k) for k in range(6))
            n, held = batch.num_rows, Parities(p.to_pylist() + q.to_pylist())
            apart = np.array([held.apart(k, np.array([n + k]))[0] for k in range(n)], np.int64)
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(apart <= most_apart(x.to_numpy(), y.to_numpy(), threshold), pa.bool_()))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= threshold * (len(x) + len(y) - both) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    odd = _of_sets(rows, _ends(pairs), prints, shingle, "candidate-parities", whole=False)
    one, two = odd.df.toDF("a", "x", "p"), odd.df.toDF("b", "y", "q")
    likely = Written(pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y", "p", "q").mapInArrow(allowed, "a long, b long"), "likely-pairs", narrow=True)
    odd.drop()
    sets = _of_sets(rows, _ends(likely.df), prints, shingle, "candidate-sets", whole=True)
    one, two = sets.df.toDF("a", "x"), sets.df.toDF("b", "y")
    links = Written(likely.df.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(compare, "a long, b long"), "similar", narrow=True).df
    sets.drop()
    likely.drop()
    return links


def near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY, shingle: int = SHINGLE, slot_col: str | None = None, sample: int = SAMPLE
) -> DataFrame:
    """doc_id, component_id (smallest id reachable through pairs of at least this similarity).

    slot_col: docs is a table that lies in buckets by this column, as ``laid_out`` makes it; the result has it too, as slot.
    """
    spark = docs.sparkSession
    short_batches(spark)
    lying = None
    if slot_col is None:
        lying = laid_out(columns(docs, doc_id=id_col, text=text_col).where("doc_id is not null"), bucket_count(spark), by_split=True)
        docs, id_col, text_col, slot_col = lying.df, "doc_id", "text", "slot"
    rows = columns(docs, doc_id=id_col, text=text_col, slot=slot_col).select(F.col("doc_id").cast("long"), F.col("text").cast("string"), "slot").where("doc_id is not null")
    heads = Bucketed(_heads(rows, shingle, threshold, sample), "shingle_heads", bucket_count(spark), ["slot"], sort=False)
    keys = Written(heads.df.select("slot", "doc_id", "k1", "k2"), "set-keys").df
    first = keys.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "slot")).alias("first"))
    reps = Written(first.select("k1", "k2", F.col("first.doc_id").alias("rep"), F.col("first.slot").alias("slot")), "shingle-classes", narrow=True).df
    with settings(spark, **AS_THEY_LIE):
        sets = heads.df.withColumnRenamed("doc_id", "rep").where("n > 0").join(reps.hint("shuffle_hash"), ["slot", "rep", "k1", "k2"])
        prints = Written(sets.select("slot", "rep", "n", "f1", "f2", F.size("head").alias("heads")), "set-fingerprints", narrow=True).df
        met = shared(sets, prints.agg(F.sum("heads")).first()[0] or 0).join(prints, "rep")
        meet = Written(met.select("token", "rep", "n", "f1", "f2"), "shared-shingles").df
    heads.drop()
    pairs = Written(star_pairs(meet.withColumn("comp", F.col("rep")), threshold).unionByName(fingerprint_pairs(prints)).distinct(), "candidate-pairs", narrow=True)
    links = settled(rows, pairs.df, prints, shingle, threshold)
    pairs.drop()
    joined = components(links)
    apart = meet.join(joined, meet["rep"] == joined["node"], "left").select("token", "rep", "n", "f1", "f2", F.coalesce("component", "rep").alias("comp"))
    left = Written(unsettled(apart, threshold), "unsettled", narrow=True).df
    odd = _of_sets(rows, left.select(F.col("rep").alias("id")).distinct(), prints, shingle, "unsettled-parities", whole=False)
    close = Written(unrefuted(left, odd.df, threshold), "unrefuted", narrow=True).df
    odd.drop()
    sets = _of_sets(rows, close.select(F.col("rep").alias("id")).distinct(), prints, shingle, "unsettled-sets", whole=True)
    links = links.unionByName(joined_sets(sets.df, close, threshold))
    sets.drop()
    if lying is not None:
        lying.drop()
    ends = components(links)
    ends = Written(reps.join(ends, reps["rep"] == ends["node"], "left").select("k1", "k2", F.coalesce("component", "rep").alias("component_id")), "shingle-components", narrow=True).df
    found = keys.join(ends, ["k1", "k2"])
    return found.select("doc_id", "component_id") if lying is not None else found.select("doc_id", "component_id", "slot")
