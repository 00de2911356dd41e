"""Scoring of retrieval against gold evidence."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from foliant.functions.text import ngrams
from foliant.sources.places import placed
from foliant.sources.scratch import cut
from foliant.sources.workers import lean


def gram_counts(texts: DataFrame, key: list[str], n: int = 3) -> DataFrame:
    """key, gram, count over the multiset of n-grams."""
    return texts.select(*key, F.explode(ngrams(F.col("text"), n)).alias("gram")).groupBy(*key, "gram").agg(F.count("*").alias("n"))


#: Characters whose n-grams are counted at a time.
BLOCK = 1 << 20


def _grams(text: str, n: int) -> np.ndarray:
    """The n-grams of a text as values that compare (a shorter text is one, filled up by what no character is); none without text."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) + np.uint32(1)
    if 0 < len(codes) < n:
        codes = np.pad(codes, (0, n - len(codes)))
    if len(codes) < n:
        return np.zeros(0, np.uint64)
    if n <= 3:  # 21 bits a character
        parts = [codes[i : len(codes) - n + 1 + i].astype(np.uint64) << np.uint64(21 * i) for i in range(n)]
        return np.bitwise_or.reduce(parts)
    rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(codes, n))
    return rows.view(f"<U{n}").ravel()


#: Characters of texts that are made strings at a time.
SLICE = 1 << 22


def _coverage(text: str, texts: list[str], n: int, ks: tuple[int, ...]) -> list[float]:
    """A gold text's coverage by all of some texts, then by the first k for each of ks."""
    stops = [len(texts), *(max(0, min(k, len(texts))) for k in ks)]
    if not text:
        return [0.0] * len(stops)
    whole = next((i for i, x in enumerate(texts) if text in x), len(texts))  # from that node on all is there
    want, count = np.unique(_grams(text, n), return_counts=True)
    have, at = np.zeros(len(want), np.int64), {}
    for i in range(min(whole, max(stops)) + 1):
        at[i] = float(np.minimum(count, have).sum() / count.sum()) if i in stops else 0.0
        if i < len(texts):
            for lo in range(0, max(len(texts[i]) - n + 1, 1), BLOCK):
                grams = _grams(texts[i][lo : lo + BLOCK + n - 1], n)
                place = np.minimum(np.searchsorted(want, grams), len(want) - 1)
                have += np.bincount(place[want[place] == grams], minlength=len(want))
    return [1.0 if k > whole else at[k] for k in stops]


def _covered(rows: DataFrame, n: int, ks: tuple[int, ...]) -> DataFrame:
    """rows (text, _nodes: texts in order) with _c, their _coverage(); workers make strings of SLICE characters at a time, and give memory back."""
    schema = T.StructType([*rows.schema.fields, T.StructField("_c", T.ArrayType(T.DoubleType()))])
    text, nodes = rows.columns.index("text"), rows.columns.index("_nodes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pc.fill_null(pc.list_value_length(batch.column(nodes)), 0)
            size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy().astype(np.int64)
            inner = np.concatenate(([0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(nodes).flatten()), 0).to_numpy())))
            stops = np.cumsum(own.to_numpy())
            part = np.cumsum(size + inner[stops] - inner[stops - own.to_numpy()]) // SLICE
            for lo, hi in zip((cuts := np.flatnonzero(np.diff(part, prepend=-1))), [*cuts[1:], len(batch)], strict=True):
                some = batch.slice(lo, hi - lo)
                found = [_coverage(x, [y or "" for y in own or []], n, ks) for x, own in zip(some.column(text).to_pylist(), some.column(nodes).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(found, pa.list_(pa.float64()))], names=[*some.schema.names, "_c"])

    return rows.mapInArrow(lean(run), schema)


def evidence_coverage(gold: DataFrame, nodes: DataFrame, n: int = 3) -> DataFrame:
    """case_id, coverage: 1 if a node of the case contains the gold text, else the share of its 3-grams (with repetition) that its nodes have.

    gold: case_id, text, one row a case; nodes: case_id, text, both normalised.
    Empty gold has 0. Texts of a case meet in one row, so no gram is shuffled.
    """
    own = nodes.groupBy("case_id").agg(F.collect_list("text").alias("_nodes"))
    rows = gold.select("case_id", "text").join(own, "case_id", "left")
    return _covered(rows, n, ()).select("case_id", F.col("_c")[0].alias("coverage"))


# How notes name the gold anchor.
ANCHOR = r"(?i)anchor=((?:p|tbl)_\d+)"


def _touches(anchor: Column, start: Column, end: Column) -> Column:
    """Whether an anchor is an end of a range, or a paragraph within a range of paragraphs."""
    number = lambda c: F.regexp_extract(F.lower(c), r"^p_(\d+)$", 1).try_cast("bigint")
    inside = number(anchor).between(number(start), number(end))
    equal = anchor.eqNullSafe(F.lower(start)) | anchor.eqNullSafe(F.lower(end))
    return (anchor != "") & (equal | F.coalesce(inside, F.lit(False)))


def anchor_hit(gold: DataFrame, retrieved: DataFrame) -> DataFrame:
    """case_id, rank, anchor_hit: the gold anchor (in notes) is an end of the range, or a paragraph within it."""
    rows = retrieved.join(gold.select("case_id", F.lower(F.regexp_extract("notes", ANCHOR, 1)).alias("_a")), "case_id")
    return rows.select("case_id", "rank", _touches(F.col("_a"), F.col("start_anchor"), F.col("end_anchor")).alias("anchor_hit"))


def score_at_k(gold: DataFrame, retrieved: DataFrame, ks: tuple[int, ...] = (1, 3, 5), least: float = 0.8) -> DataFrame:
    """gold (case_id, row_number, text, notes) with coverage, anchor_hit and hit by all nodes of its case, and _at_k by the first k.

    retrieved: case_id, rank, text, start_anchor, end_anchor. Texts are
    normalised; a hit is an anchor hit or a coverage of least at least.
    """
    node = F.struct("rank", "text", "start_anchor", "end_anchor")
    own = retrieved.groupBy("case_id").agg(F.array_sort(F.collect_list(node)).alias("_nodes"))
    rows = gold.join(own, "case_id", "left").withColumn("_a", F.lower(F.regexp_extract(F.coalesce("notes", F.lit("")), ANCHOR, 1)))
    starts = F.transform("_nodes", lambda x: x.dropFields("text"))
    rows = _covered(rows.withColumns({"_at": starts, "_nodes": F.transform("_nodes", lambda x: x["text"])}), 3, ks).drop("_nodes").withColumnRenamed("_at", "_nodes")
    added = {}
    for i, (k, suffix) in enumerate([(None, ""), *((k, f"_at_{k}") for k in ks)]):
        nodes = F.coalesce("_nodes", F.array()) if k is None else F.slice(F.coalesce("_nodes", F.array()), 1, k)
        touched = F.exists(nodes, lambda x: _touches(F.col("_a"), x["start_anchor"], x["end_anchor"])) if k is None or k > 0 else F.lit(False)
        touched = F.coalesce(F.when(F.col("_nodes").isNotNull(), touched), F.lit(False))
        added |= {f"coverage{suffix}": F.round(F.col("_c")[i], 6), f"anchor_hit{suffix}": touched.cast("int"), f"hit{suffix}": (touched | (F.col("_c")[i] >= least)).cast("int")}
    return rows.withColumns(added).drop("_nodes", "_a", "_c")


def _by_case(rows: DataFrame, *more: Column) -> DataFrame:
    pos = F.col("label") == 1
    out = rows.groupBy("case_id").agg(F.count(F.when(pos, 1)).alias("n"), F.sum(F.when(pos, F.col("hit"))).alias("hits"), F.count(F.when(F.coalesce("error", F.lit("")) != "", 1)).alias("errors"), *more)
    status = F.when(F.col("errors") > 0, "ERROR").when(F.col("n") == 0, "SKIP").when(F.col("hits") == F.col("n"), "PASS").otherwise("FAIL")
    return out.withColumns({"recall": F.when(F.col("errors") == 0, F.col("hits") / F.col("n")), "status": status})


def case_metrics(rows: DataFrame) -> DataFrame:
    """case_id, n, recall, status of rows (case_id, label, hit, error): the share of a case's positive rows that hit.

    ERROR if any row has an error (recall null), SKIP without positive rows,
    PASS if all hit, else FAIL.
    """
    return _by_case(rows).select("case_id", "n", "recall", "status")


def summary_metrics(rows: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """One row: cases by status, strict accuracy and macro recall over cases with positives, micro recall and micro recall at k over their rows.

    rows: those of score_at_k() with label and error, read once: cases carry
    their rows' sums. Cases and rows with an error are in no denominator;
    without any, measures are 0.
    """
    kept = (F.col("label") == 1) & (F.coalesce("error", F.lit("")) == "")
    hits = {"micro": "hit"} | {f"micro_at_{k}": f"hit_at_{k}" for k in ks}
    sums = [f(F.when(kept, F.col(c).cast("double"))).alias(f"_{x}_{name}") for name, c in hits.items() for x, f in (("sum", F.sum), ("n", F.count))]
    cases = _by_case(rows, F.count(F.when(kept, 1)).alias("_kept"), *sums)
    n = lambda s: F.count(F.when(F.col("status") == s, 1))
    share = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    positive = n("PASS") + n("FAIL")
    recall = F.when(F.col("status").isin("PASS", "FAIL"), F.col("recall"))
    return cases.agg(
        F.count("*").alias("cases"), positive.alias("positive_cases"), n("SKIP").alias("negative_cases"), n("ERROR").alias("failed_cases"), share(n("PASS"), positive).alias("strict"), F.round(F.coalesce(F.avg(recall), F.lit(0.0)), 6).alias("macro"),
        F.coalesce(F.sum("_kept"), F.lit(0)).alias("evidence"), *(share(F.sum(f"_sum_{name}"), F.sum(f"_n_{name}")).alias(name) for name in hits),
    )


def percentile(x: Column, p: float) -> Column:
    """Linear interpolation; null on no values. For groups of bounded size, as it keeps their values in one buffer; others: percentiles()."""
    return F.round(F.percentile(x, p), 3)


def percentiles(rows: DataFrame, key: str, value: str, shares: dict[str, float]) -> DataFrame:
    """key and, for each share, its exact percentile of a key's values (linear between neighbours, rounded to 3; nulls left out).

    Values are ranked over range partitions and picked by rank, so that a key
    of any number of values is in no buffer and no task alone.
    """
    known = cut(rows.select(key, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL"), "values")
    ranked = placed(known, ["_v"], [key])
    picks = []
    for name, share in shares.items():
        at = (F.col("of") - 1) * F.lit(share)
        picks += [F.max(F.when(F.col("place") == f(at), F.col("_v"))).alias(f"_{x}_{name}") for x, f in (("lo", F.floor), ("hi", F.ceil))]
    found = ranked.groupBy(key).agg(F.max("of").alias("_of"), *picks)

    def between(name: str, share: float) -> Column:
        part = (F.col("_of") - 1) * F.lit(share) - F.floor((F.col("_of") - 1) * F.lit(share))
        return F.round(F.col(f"_lo_{name}") * (1 - part) + F.col(f"_hi_{name}") * part, 3)

    return found.select(key, *(between(n, p).alias(n) for n, p in shares.items()))


def contract_metrics(latency: DataFrame, key: str, seconds: str, builds: DataFrame | None = None) -> DataFrame:
    """key, n, mean, p50, p95, max of seconds; with builds (key, build_seconds) also those, null and index_built false where there is none."""
    s = F.col(seconds)
    whole = latency.groupBy(key).agg(F.count("*").alias("n"), F.round(F.avg(s), 3).alias("mean"), F.round(F.max(s), 3).alias("max"))
    same = percentiles(latency, key, seconds, {"p50": 0.5, "p95": 0.95}).withColumnRenamed(key, "_key")
    out = whole.join(same, F.col(key).eqNullSafe(F.col("_key")), "left").select(key, "n", "mean", "p50", "p95", "max")
    return out if builds is None else out.join(builds.select(key, "build_seconds"), key, "left").withColumn("index_built", F.col("build_seconds").isNotNull())


def unique_nodes(rows: DataFrame) -> DataFrame:
    """One row for each (case_id, node_id, start_anchor, end_anchor), that of the smallest rank; anchors count if rows have them."""
    w = Window.partitionBy("case_id", "node_id", *(x for x in ("start_anchor", "end_anchor") if x in rows.columns)).orderBy("rank")
    return rows.withColumn("_i", F.row_number().over(w)).where("_i = 1").drop("_i")


def select_ranges(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """Rows whose row_number lies in any 1-based inclusive range, each once."""
    r = ranges.select(F.col("first").alias("_a"), F.col("last").alias("_z"))
    return rows.join(r, F.col("row_number").between(F.col("_a"), F.col("_z")), "left_semi")


def range_errors(ranges: DataFrame, n_rows: int) -> DataFrame:
    """Ranges (first, last) that are none: turned round, or beyond the rows 1 to n_rows."""
    return ranges.where((F.col("first") < 1) | (F.col("last") < F.col("first")) | (F.col("last") > n_rows))


def limit_cases(rows: DataFrame, n: int) -> DataFrame:
    """All rows of the first n cases in the order of their first row."""
    first = rows.groupBy("case_id").agg(F.min("row_number").alias("_first")).orderBy("_first").limit(n)
    return rows.join(first.select("case_id"), "case_id", "left_semi")


def resolve_index(gold: DataFrame, indexes: DataFrame) -> DataFrame:
    """gold with index_id: by full path, else file name, else cleaned stem, without case."""
    stem = lambda c: F.regexp_replace(F.regexp_replace(F.lower(c), r"\.[^.]*$", ""), r"[^a-z0-9]+", "_")
    name = lambda c: F.lower(F.substring_index(c, "/", -1))
    out = gold
    for i, key in enumerate((F.lower, name, lambda c: stem(name(c)))):
        found = indexes.groupBy(key(F.col("path")).alias(f"_k{i}")).agg(F.min("index_id").alias(f"_i{i}"))
        out = out.withColumn(f"_k{i}", key(F.col("contract_path"))).join(found, f"_k{i}", "left").drop(f"_k{i}")
    return out.withColumn("index_id", F.coalesce("_i0", "_i1", "_i2")).drop("_i0", "_i1", "_i2")


#: Shares of clause and point in a match.
SHARES = (0.35, 0.65)


#: Pairs of characters from which two texts are compared as arrays, and up to how many pairs of equal bigrams and characters of a text; others are left to difflib.
LEAST_PAIRS, MOST_BIGRAMS, MOST_CHARS = 1 << 11, 1 << 23, 1 << 20


def _runs(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Longest runs of at least two equal characters: where they begin in x and in y, and their length; None if equal bigrams are too many."""
    p, q = ((c[:-1].astype(np.uint64) << np.uint64(32)) | c[1:] for c in (x, y))
    order = np.argsort(q, kind="stable")
    q = q[order]
    low = np.searchsorted(q, p)
    n = np.searchsorted(q, p, "right") - low
    total = int(n.sum())
    if total > MOST_BIGRAMS:
        return None
    i = np.repeat(np.arange(len(p)), n)
    j = order[np.arange(total) + np.repeat(low - np.cumsum(n) + n, n)]
    # bigrams that follow each other on a diagonal are one run
    key = np.sort(((j - i + len(x)) << 32) | i)
    first = np.flatnonzero(np.diff(key, prepend=-2) != 1)
    i = key[first] & 0xFFFFFFFF
    return i, (key[first] >> 32) - len(x) + i, np.diff(first, append=total) + 1


def matching(a: str, b: str) -> int | None:
    """The characters in difflib's matching blocks of two texts: the longest run (the first in a, then in b), then those to its left and to its right; None for texts beyond the bounds above.

    What lies to the left and right of blocks is searched in one step for all of
    them. A run that a block cuts lies on one side of it only, as it is no longer
    than the block. Where no two neighbours match any more, blocks are single
    characters, each the first that can follow.
    """
    if max(len(a), len(b)) >= MOST_CHARS:
        return None
    x, y = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (a, b))
    found = _runs(x, y)
    if found is None:
        return None
    i, j, size = found
    part, total, low, gaps = np.zeros(len(i), np.int64), 0, (1 << 20) - 1, []
    # where parts begin and end in a and in b
    parts = np.array([[0, len(a), 0, len(b)]])
    if not len(i):
        gaps.append(parts)
    while len(i):
        best = np.zeros(len(parts), np.int64)
        np.maximum.at(best, part, (size << 40) | ((low - i) << 20) | (low - j))
        k, at, to = best >> 40, low - ((best >> 20) & low), low - (best & low)
        total += int(k.sum())
        both = np.empty((2 * len(parts), 4), np.int64)
        both[::2] = np.column_stack((parts[:, 0], at, parts[:, 2], to))
        both[1::2] = np.column_stack((at + k, parts[:, 1], to + k, parts[:, 3]))
        at, to, k = at[part], to[part], k[part]
        before = np.minimum(size, np.minimum(at - i, to - j))
        skip = np.maximum(np.maximum(at + k - i, to + k - j), 0)
        left = np.flatnonzero(before > 1)
        right = np.flatnonzero(skip < size - 1)
        part = np.concatenate((2 * part[left], 2 * part[right] + 1))
        i, j = (np.concatenate((c[left], (c + skip)[right])) for c in (i, j))
        size = np.concatenate((before[left], (size - skip)[right]))
        there = np.zeros(len(both), bool)
        there[part] = True
        gaps.append(both[~there])
        part, parts = (np.cumsum(there) - 1)[part], both[there]
    for a0, a1, b0, b1 in np.concatenate(gaps).tolist():
        for c in a[a0:a1] if b0 < b1 else "":
            place = b.find(c, b0, b1)
            if place >= 0:
                total, b0 = total + 1, place + 1
    return total


def block_ratio(a: str, b: str) -> float:
    """Twice the characters in matching blocks (the longest first, then to its left and right) by all characters; 0 for empty texts."""
    same = matching(a, b) if len(a) * len(b) >= LEAST_PAIRS else None
    if same is not None:
        return 2.0 * same / (len(a) + len(b))
    return SequenceMatcher(None, a, b, autojunk=False).ratio() if a or b else 0.0


def length_bound(a: str, b: str) -> float:
    """No block ratio is higher: every matching character is in both texts."""
    return 2.0 * min(len(a), len(b)) / (len(a) + len(b)) if a or b else 0.0


def letter_bound(a: Counter, b: Counter, size: int) -> float:
    """No block ratio of texts with these characters, size together, is higher."""
    return 2.0 * sum((a & b).values()) / size if size else 0.0


def best_prediction(clause: str, point: str, predictions: list[tuple[int, str, str]]) -> tuple[int, float, int] | None:
    """The number and match of the best prediction (number, clause, point), ties to the smallest number, and how many were compared exactly.

    Predictions come in the order of the bound by length; those that can beat
    or tie the best so far get the bound by characters, then the exact ratios.
    """
    mine = (clause, point)
    letters = [Counter(x) for x in mine]
    bounds = [(-sum(s * length_bound(x, y) for s, x, y in zip(SHARES, mine, p[1:], strict=True)), p[0], i) for i, p in enumerate(predictions)]
    best, compared = None, 0
    for bound, number, i in sorted(bounds):
        if best is not None and round(-bound, 6) < -best[0]:
            break
        theirs = predictions[i][1:]
        closer = sum(s * letter_bound(x, Counter(y), len(m) + len(y)) for s, x, m, y in zip(SHARES, letters, mine, theirs, strict=True))
        if best is not None and (-round(closer, 6), number) > best:
            continue
        compared += 1
        found = (-round(sum(s * block_ratio(x, y) for s, x, y in zip(SHARES, mine, theirs, strict=True)), 6), number)
        best = found if best is None else min(best, found)
    return None if best is None else (best[1], -best[0], compared)


@F.pandas_udf(T.StructType([T.StructField("predicted_no", T.LongType()), T.StructField("match", T.DoubleType()), T.StructField("compared", T.IntegerType())]))
def _best(clause: pd.Series, point: pd.Series, predictions: pd.Series) -> pd.DataFrame:
    out = []
    for c, p, each in zip(clause, point, predictions, strict=True):
        rows = [] if each is None else [(int(x["predicted_no"]), x["clause"] or "", x["point"] or "") for x in each]
        out.append(best_prediction(c or "", p or "", rows) or (None, None, None))
    return pd.DataFrame(out, columns=["predicted_no", "match", "compared"])


def gram_share(a: Column, b: Column) -> Column:
    """Jaccard share of 3-grams; 0 for empty texts."""
    a, b = F.array_distinct(ngrams(a)), F.array_distinct(ngrams(b))
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both, F.size(a) + F.size(b) - both), F.lit(0.0))


#: Characters of notes, and of predictions, that meet at a time.
CHUNK = 1 << 16
#: What lies so near to a note's best match may round to the same or a better one.
NEAR = 2e-6


#: Notes whose best predictions by the block ratio are one task's.
NOTES = 512


def _chunks(notes: DataFrame, number: str, name: str) -> DataFrame:
    """doc_id and lists of (number, clause, point) of CHUNK characters, or one note's."""
    so_far = Window.partitionBy("doc_id").orderBy(number).rowsBetween(Window.unboundedPreceding, 0)
    size = F.lit(64) + F.coalesce(F.length("clause"), F.lit(0)) + F.coalesce(F.length("point"), F.lit(0))
    each = notes.select("doc_id", F.floor(F.sum(size).over(so_far) / CHUNK).alias("_k"), F.struct(F.col(number).alias("no"), "clause", "point").alias("_x"))
    return each.groupBy("doc_id", "_k").agg(F.collect_list("_x").alias(name)).drop("_k")


def _shares(mine: pa.Array, theirs: pa.Array) -> Iterator[np.ndarray]:
    """For each of my texts its gram_share() with each of theirs."""
    sets = [np.unique(_grams(x or "", 3)) for x in theirs.to_pylist()]
    size = np.array([len(x) for x in sets])
    grams = np.concatenate([*sets, np.zeros(0, np.uint64)]).astype(np.uint64)
    order = np.argsort(grams, kind="stable")
    grams, of = grams[order], np.repeat(np.arange(len(sets)), size)[order]
    for text in mine.to_pylist():
        own = np.unique(_grams(text or "", 3)).astype(np.uint64)
        lo, hi = np.searchsorted(grams, own), np.searchsorted(grams, own, "right")
        n = hi - lo
        at = np.arange(n.sum()) + np.repeat(lo - np.cumsum(n) + n, n)
        both = np.bincount(of[at], minlength=len(sets))
        either = len(own) + size - both
        yield np.divide(both, either, out=np.zeros(len(sets)), where=either > 0)


def _best_by_grams(human: DataFrame, predicted: DataFrame) -> DataFrame:
    """doc_id, human_no, predicted_no, match of each note's best prediction by gram_share().

    Tasks keep of a note and a chunk what may be best once rounded, of equal
    matches the smallest number; rounding and the choice are Spark's.
    """
    pairs = _chunks(human, "human_no", "_h").join(_chunks(predicted, "predicted_no", "_p"), "doc_id")
    kinds = [pairs.schema["doc_id"].dataType, human.schema["human_no"].dataType, predicted.schema["predicted_no"].dataType]
    names = ["doc_id", "human_no", "predicted_no", "match"]
    schema = T.StructType([T.StructField(x, t) for x, t in zip(names, [*kinds, T.DoubleType()], strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(len(batch)):
                mine, theirs = (batch.column(k)[i].values.flatten() for k in (1, 2))
                # places in the order of their numbers, null first
                order = pc.sort_indices(theirs[0], null_placement="at_start")
                theirs = [x.take(order) for x in theirs]
                notes, picks, found = [], [], []
                for j, parts in enumerate(zip(*(_shares(x, y) for x, y in zip(mine[1:], theirs[1:], strict=True)), strict=True)):
                    match = sum(s * part for s, part in zip(SHARES, parts, strict=True))
                    near = np.flatnonzero(match >= match.max() - NEAR)
                    value, first = np.unique(match[near], return_index=True)
                    notes += [j] * len(value)
                    picks.append(near[first])
                    found.append(value)
                columns = [pa.repeat(batch.column(0)[i], len(notes)), mine[0].take(pa.array(notes, pa.int64())), theirs[0].take(pa.array(np.concatenate(picks))), pa.array(np.concatenate(found))]
                out.append(pa.RecordBatch.from_arrays(columns, names=names))
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    near = pairs.select("doc_id", "_h", "_p").mapInArrow(lean(run), schema).withColumn("match", F.round("match", 6))
    best = near.groupBy("doc_id", "human_no").agg(F.min(F.struct((-F.col("match")).alias("m"), "predicted_no")).alias("_b"))
    return best.select("doc_id", "human_no", "_b.predicted_no", (-F.col("_b.m")).alias("match"))


def match_annotations(human: DataFrame, predicted: DataFrame, hit: float = 0.6, unsure: float = 0.4, similar: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """For each human note of a document its best prediction, with match = 0.35 clause + 0.65 point similarity; status by the two thresholds, which are parameters.

    similar: a column function of two texts in place of the block ratio, for
    which bounds by length and by characters leave few pairs to compare
    exactly. A document's notes meet its predictions, as both are what people
    and models write about one document; for gram_share they do so in chunks of
    bounded size, and each text's 3-grams are taken once for a chunk.
    """
    if similar is None:
        rows = predicted.groupBy("doc_id").agg(F.collect_list(F.struct("predicted_no", "clause", "point")).alias("_all"))
        # texts are few bytes and much work: without a number of its own Spark puts them into few tasks
        tasks = -(-human.count() // NOTES)
        best = human.join(rows, "doc_id").repartition(max(1, tasks), "doc_id", "human_no").select("doc_id", "human_no", _best("clause", "point", "_all").alias("_b"))
        best = best.select("doc_id", "human_no", F.col("_b.predicted_no").cast(predicted.schema["predicted_no"].dataType).alias("predicted_no"), "_b.match")
    elif similar is gram_share:
        best = _best_by_grams(human, predicted)
    else:
        pairs = human.alias("h").join(predicted.alias("p"), "doc_id")
        scored = pairs.select("doc_id", "h.human_no", "p.predicted_no", similar(F.col("h.clause"), F.col("p.clause")).alias("_c"), similar(F.col("h.point"), F.col("p.point")).alias("_p"))
        scored = scored.select("doc_id", "human_no", "predicted_no", F.round(SHARES[0] * F.col("_c") + SHARES[1] * F.col("_p"), 6).alias("match"))
        best = scored.groupBy("doc_id", "human_no").agg(F.min(F.struct((-F.col("match")).alias("m"), "predicted_no")).alias("_b"))
        best = best.select("doc_id", "human_no", "_b.predicted_no", (-F.col("_b.m")).alias("match"))
    out = human.select("doc_id", "human_no").join(best, ["doc_id", "human_no"], "left")
    return out.withColumn("status", F.when(F.col("match") >= hit, "hit").when(F.col("match") >= unsure, "uncertain").otherwise("miss"))


def annotation_recall_report(matches: DataFrame, file: str) -> DataFrame:
    """hits, misses, uncertain, recall and upper bound for each file and in total (null)."""
    n = lambda s: F.count(F.when(F.col("status") == s, 1))
    out = matches.rollup(file).agg(F.count("*").alias("n"), n("hit").alias("hit"), n("miss").alias("miss"), n("uncertain").alias("uncertain"))
    return out.withColumns({"recall": F.col("hit") / F.col("n"), "upper": (F.col("hit") + F.col("uncertain")) / F.col("n")})


def verify_anchored_text(spans: DataFrame, runs: DataFrame) -> DataFrame:
    """spans (doc_id, pos, first_run, last_run, expected) with captured and matched: the text of the runs in the span."""
    inside = spans.alias("s").join(runs.alias("r"), (F.col("s.doc_id") == F.col("r.doc_id")) & (F.col("s.pos") == F.col("r.pos")) & F.col("r.run_no").between(F.col("s.first_run"), F.col("s.last_run")))
    got = inside.groupBy("s.doc_id", "s.pos", "s.expected").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r.run_no", "r.text"))), lambda x: x["text"]), " ").alias("captured"))
    return got.withColumn("matched", F.col("captured") == F.col("expected"))


def status_counts(rows: DataFrame, status: str = "status") -> DataFrame:
    return rows.groupBy(status).agg(F.count("*").alias("n"))
