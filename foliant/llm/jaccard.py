"""Exact n-gram Jaccard self-join by rare-first prefix filtering.

Documents with equal shingle sets form a class, and classes are joined:

1. A pass over the texts gives each document its set's size, hash and bins,
   and a count sketch of all shingles: fixed size, so it can be broadcast.
2. Each class orders its shingles rarest first (by the sketch, then by hash;
   any one order for all is right) and posts only its prefix: two sets of
   sizes n and m that link share at least a(n, m) shingles, so their first
   common shingle stands before n - a in one and before m - a in the other.
   Postings that no other class shares fall away at once.
3. Pairs come from common postings under the length and positional filters,
   pass the suffix filter (a Hamming bound from bin sizes), and are verified
   once each, on whole sets.

What is asked for is the components of the link graph, so a group of near
copies need not be expanded into all its pairs: each posting list is first
compared with its most typical member alone, and after that only pairs whose
ends still lie in different components are looked at. No link between
components is missed, as all of those pairs are verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm import words
from foliant.llm.graph import connected_components
from foliant.llm.storage import bitmap, cut, lean, marked, release

#: Counters of the sketch, and how many travel in a row.
SKETCH_BITS, SLICE_BITS = 20, 12
#: Bits of the bitmap of texts whose sets are looked at (8 MB).
MARK_BITS = 26
#: Pairs of one class that are verified in one place.
HOT = 256
#: Bins of the suffix filter.
BINS = 16


@dataclass(frozen=True)
class Rule:
    """k-word shingles; sets link when den * intersection >= num * union."""

    k: int = 5
    num: int = 80
    den: int = 100

    def overlap(self, n: Column, m: Column) -> Column:
        """Least intersection of linked sets of sizes n and m."""
        both = self.num + self.den
        return F.floor(((n + m) * self.num + (both - 1)) / both).cast("int")

    def prefix(self, n: int) -> int:
        """Shingles to post for a set of size n: against any other size."""
        return n - -(-self.num * n // self.den) + 1

    def core(self, n: Column) -> Column:
        """Those that matter against sets of at least its size."""
        return n - self.overlap(n, n) + 1


def _class_ids(sets: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of each set; 0 for the empty one."""
    size = np.array([len(s) for s in sets], np.uint64)
    out = np.zeros(len(sets), np.uint64)
    full = np.flatnonzero(size)
    if len(full):
        flat = words.mix(np.concatenate([sets[i] for i in full]) ^ np.uint64(0xD6E8FEB86659FD93))
        start = np.concatenate(([0], np.cumsum(size[full])[:-1])).astype(np.int64)
        out[full] = words.mix(np.add.reduceat(flat, start) + size[full] * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
    return out.view(np.int64)


def _list_array(sets: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
    flat = np.concatenate(sets) if sets else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def _shingled(docs: DataFrame, doc_id: str, text: str, rule: Rule) -> DataFrame:
    """A row for each document (slice null), and rows of the sketch (slice set)."""
    id_type = docs.schema[doc_id].dataType
    schema = T.StructType().add("doc_id", id_type).add("n_shingles", "long").add("cls", "long").add("bins", T.ArrayType(T.ShortType()))
    schema = schema.add("slice", "integer").add("at", T.ArrayType(T.IntegerType())).add("n", T.ArrayType(T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, np.int64)
        names = [f.name for f in schema]
        ids = None
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, raw, offsets in words.slices(batch.column(1)):
                sets = words.shingle_sets(words.split(raw, offsets, words.SPACED), rule.k)
                flat = np.concatenate(sets)
                sketch += np.bincount((flat >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS)
                bins = [np.minimum(np.bincount((s & np.uint64(BINS - 1)).astype(np.int64), minlength=BINS), 32767) for s in sets]
                n = hi - lo
                none = [pa.nulls(n, kind) for kind in (pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([ids.slice(lo, n), pa.array([len(s) for s in sets], pa.int64()), pa.array(_class_ids(sets)), _list_array(bins, pa.int16()), *none], names=names)
        part = 1 << SLICE_BITS
        for k in range(0, 1 << SKETCH_BITS, part) if ids is not None else ():
            at = np.flatnonzero(sketch[k : k + part])
            if len(at):
                row = [pa.nulls(1, ids.type), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.int16())), pa.array([k // part], pa.int32()), pa.array([at + k], pa.list_(pa.int32())), pa.array([sketch[k : k + part][at]], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(row, names=names)

    return docs.select(doc_id, text).mapInArrow(lean(run), schema)


def _sketch(shingled: DataFrame) -> np.ndarray:
    """All counters, at most 2**SKETCH_BITS rows to the driver."""
    rows = shingled.where("slice is not null").select("slice", "at", "n").repartition("slice")
    pairs = rows.select("slice", F.explode(F.arrays_zip("at", "n")).alias("x")).select("slice", "x.at", "x.n")
    found = pairs.groupBy("slice", "at").agg(F.sum("n").alias("n")).select("at", F.least("n", F.lit((1 << 32) - 1)).alias("n")).toArrow()
    sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
    sketch[found["at"].to_numpy()] = found["n"].to_numpy()
    return sketch


def _postings(docs: DataFrame, text: str, rule: Rule, sketch: np.ndarray) -> DataFrame:
    """gram, cls, n (set size), pos (place in the rare-first order) for each prefix."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            for _, _, raw, offsets in words.slices(batch.column(0)):
                sets = words.shingle_sets(words.split(raw, offsets, words.SPACED), rule.k)
                classes = _class_ids(sets)
                grams, pos, size, cls = [], [], [], []
                for s, c in zip(sets, classes, strict=True):
                    if len(s):
                        often = counts[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                        order = np.argsort(often, kind="stable")[: rule.prefix(len(s))]
                        at = np.flatnonzero(often[order] > 1)  # a counter of 1 is one document's own
                        grams.append(s[order[at]])
                        pos.append(at)
                        size.append(np.full(len(at), len(s)))
                        cls.append(np.full(len(at), c))
                if grams:
                    columns = [np.concatenate(grams).view(np.int64), np.concatenate(cls), np.concatenate(size).astype(np.int32), np.concatenate(pos).astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["gram", "cls", "n", "pos"])

    return docs.select(text).mapInArrow(lean(run), "gram long, cls long, n int, pos int")


def _passes(rule: Rule, a: str, b: str) -> Column:
    """Length and positional filter for two postings of one shingle."""
    least = rule.overlap(F.col(f"{a}.n"), F.col(f"{b}.n"))
    return (F.col(f"{a}.pos") <= F.col(f"{a}.n") - least) & (F.col(f"{b}.pos") <= F.col(f"{b}.n") - least)


def _pair(a: str, b: str) -> list[Column]:
    return [F.least(f"{a}.cls", f"{b}.cls").alias("a"), F.greatest(f"{a}.cls", f"{b}.cls").alias("b")]


def _typical_pairs(shared: DataFrame, rule: Rule) -> DataFrame:
    """Each posting with the most typical one of its list: that with the fewest rarer shingles."""
    best = shared.groupBy("gram").agg(F.min(F.struct("pos", "n", "cls")).alias("p")).select("gram", "p.*")
    both = shared.alias("x").join(best.alias("y"), F.col("x.gram") == F.col("y.gram")).where(F.col("x.cls") != F.col("y.cls"))
    return both.where(_passes(rule, "x", "y")).select(*_pair("x", "y")).distinct()


def _open_pairs(shared: DataFrame, components: DataFrame, rule: Rule) -> DataFrame:
    """Pairs of common postings whose ends lie in different components.

    Members of the component of a list's most typical posting (side 0) are not
    compared with each other; the smaller set must hold the shingle in its core.
    """
    p = shared.join(components.select(F.col("node").alias("cls"), "component"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    lists = p.groupBy("gram").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min(F.struct("pos", "n", "cls", "component")).alias("p"))
    lists = lists.where("lo <> hi").select("gram", F.col("p.component").alias("main"))
    p = p.join(lists, "gram").withColumn("in_main", F.col("component") == F.col("main")).drop("main")
    small = p.where(F.col("pos") < rule.core(F.col("n")))
    left = small.withColumn("side", F.explode(F.when(F.col("in_main"), F.array(F.lit(0))).otherwise(F.array(F.lit(1), F.lit(2)))))
    right = p.withColumn("side", F.explode(F.when(F.col("in_main"), F.array(F.lit(2))).otherwise(F.array(F.lit(0), F.lit(1)))))
    same = (F.col("x.gram") == F.col("y.gram")) & (F.col("x.side") == F.col("y.side"))
    smaller = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.cls") < F.col("y.cls")))
    both = left.alias("x").join(right.alias("y"), same & smaller & (F.col("x.component") != F.col("y.component")) & _passes(rule, "x", "y"))
    return both.select(*_pair("x", "y")).distinct()


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, doc_id: str, text: str, rule: Rule) -> DataFrame:
    """a, b of the pairs that link, written: suffix filter, then each pair once on whole sets."""
    own = classes.select("cls", "n_shingles", "bins")
    for end in ("a", "b"):
        pairs = pairs.join(own.select(F.col("cls").alias(end), F.col("n_shingles").alias(f"n_{end}"), F.col("bins").alias(f"bins_{end}")), end)
    apart = F.aggregate(F.zip_with("bins_a", "bins_b", lambda x, y: F.abs(x.cast("int") - y.cast("int"))), F.lit(0), lambda s, x: s + x)
    most = F.col("n_a") + F.col("n_b") - 2 * rule.overlap(F.col("n_a"), F.col("n_b"))
    pairs = found = cut(pairs.where(apart <= most).select("a", "b"), "candidates")
    wanted = pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).distinct()
    wanted = cut(wanted.join(classes.select("cls", F.xxhash64("first_id").alias("place")), "cls"), "wanted")
    # texts are picked where they are read, by a bitmap of a fixed size; what it lets through beside is left out by its class
    marks = bitmap(wanted, "place", MARK_BITS)
    kept = cut(_sets(docs.select(F.col(text).alias("text"), F.xxhash64(doc_id).alias("place")), rule, marks), "sets")
    sets = kept.join(wanted.select("cls"), "cls", "left_semi").dropDuplicates(["cls"])
    # which classes are hot follows from the bare pairs, before sets are beside them
    hot = {end: _hot(pairs, end) for end in ("a", "b")}
    for end, other in (("a", "b"), ("b", "a")):
        pairs = _with_sets(pairs, sets, end, other, hot[end])
    links = cut(pairs.select("a", "b", "grams_a", "grams_b").mapInArrow(lean(_Verify(rule).run), "a long, b long"), "links")
    release(found, wanted, kept)
    return links


def _hot(pairs: DataFrame, end: str) -> DataFrame:
    """end, parts: classes of very many pairs, and in how many parts of about HOT these are to be dealt."""
    return cut(pairs.groupBy(end).agg(F.ceil(F.count("*") / HOT).cast("int").alias("parts")).where("parts > 1"), "hot")


def _with_sets(pairs: DataFrame, sets: DataFrame, end: str, other: str, hot: DataFrame) -> DataFrame:
    """pairs with grams_<end>, the set of the class at that end. Pairs of a hot class are dealt to parts by the other end, with a copy of its set for each."""
    own = sets.select(F.col("cls").alias(end), F.col("grams").alias(f"grams_{end}"))
    if hot.isEmpty():
        return pairs.join(own, end)
    cold = pairs.join(hot, end, "left_anti").join(own, end)
    dealt = pairs.join(hot, end).withColumn("part", F.pmod(F.xxhash64(other), "parts").cast("int")).drop("parts")
    copies = own.join(hot, end).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return cold.unionByName(dealt.join(copies, [end, "part"]).drop("part"))


def _sets(texts: DataFrame, rule: Rule, marks: Broadcast) -> DataFrame:
    """cls, grams of the texts whose place is marked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(marked(marks.value, batch.column(1).to_numpy().view(np.uint64), MARK_BITS)))
            for _, _, raw, offsets in words.slices(batch.column(0)):
                sets = words.shingle_sets(words.split(raw, offsets, words.SPACED), rule.k)
                yield pa.RecordBatch.from_arrays([pa.array(_class_ids(sets)), _list_array([s.view(np.int64) for s in sets], pa.int64())], names=["cls", "grams"])

    return texts.mapInArrow(lean(run), "cls long, grams array<long>")


class _Verify:
    def __init__(self, rule: Rule):
        self.rule = rule

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                size, keys = [], []
                for column in (part.column(2), part.column(3)):
                    n = np.diff(column.offsets.to_numpy())
                    owner = words.mix(np.repeat(np.arange(len(n), dtype=np.uint64), n))
                    size.append(n)
                    keys.append(column.flatten().to_numpy(zero_copy_only=False).view(np.uint64) ^ owner)
                both = np.sort(np.concatenate(keys))
                hit = both[1:][both[1:] == both[:-1]]
                mine = np.sort(keys[0])
                owner = np.repeat(np.arange(part.num_rows), size[0])[np.argsort(keys[0])]
                common = np.bincount(owner[np.searchsorted(mine, hit)], minlength=part.num_rows)
                keep = self.rule.den * common >= self.rule.num * (size[0] + size[1] - common)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(keep))


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rule: Rule = Rule()) -> DataFrame:
    """doc_id, n_shingles long, component_id: one row for each row of docs.

    component_id is the smallest id that the document reaches by links, itself
    included. Texts without words (or null) have no shingles and no link. Rows
    with a null id are not linked and have a null component. Equal texts link,
    whatever their ids; repeated rows are kept. Set and shingle hashes have 64
    bits. Other columns of docs play no part.
    """
    shingled = cut(_shingled(docs, doc_id, text, rule), "shingled")
    mine = shingled.where("slice is null").select("doc_id", "n_shingles", "cls", "bins")
    full = mine.where("n_shingles > 0 and doc_id is not null")
    classes = cut(full.groupBy("cls").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.first("n_shingles").alias("n_shingles"), F.first("bins").alias("bins")), "classes")
    # written, so that texts are not split into words again for each of its uses
    postings = cut(_postings(docs.where(F.col(doc_id).isNotNull()), text, rule, _sketch(shingled)), "posted")
    lists = postings.groupBy("gram").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo <> hi").select("gram")
    shared = cut(postings.join(lists, "gram").distinct(), "postings")
    release(postings)
    first = cut(_typical_pairs(shared, rule), "pairs")
    edges = _verified(first, classes, docs, doc_id, text, rule)
    components = cut(connected_components(edges, "a", "b"), "components")
    rest = _open_pairs(shared, components, rule).join(first, ["a", "b"], "left_anti")
    more = _verified(rest, classes, docs, doc_id, text, rule)
    if not more.isEmpty():
        release(components)
        components = cut(connected_components(edges.union(more), "a", "b"), "components")
    linked = classes.join(components, F.col("cls") == F.col("node"), "left").withColumn("component", F.coalesce("component", "cls"))
    least = linked.groupBy("component").agg(F.min("first_id").alias("component_id"), F.count("*").alias("members"))
    moved = linked.join(least, "component").where("members > 1 or first_id <> last_id")
    moved = cut(moved.select("cls", "component_id"), "moved")
    release(shared, first, edges, more, components, classes)
    out = mine.where("doc_id is not null").join(moved, "cls", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.union(mine.where("doc_id is null").select("doc_id", "n_shingles", F.col("doc_id")))
