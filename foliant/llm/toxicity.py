"""Toxicity by class-conditional Kneser-Ney models.

Two models, of toxic and of ordinary labelled texts, predict each word along a
path of beginnings: its first bytes, then longer ones, then the whole word.
Each step is an absolute-discounted share of the class's own count of the
step's start. What the discount takes from a class's counts of a start is the
weight with which the class backs off there, to continuation counts that both
classes share: a first step to the number of distinct words that it follows, a
later one to the number of distinct beginnings that its further bytes follow,
each as a share of all such numbers of its level. The discount is scaled to the
classes' sizes, so that an expression that a class has no more often moves
little, and rare forms count through the beginnings that they share.
A text counts once for each step, so that repetition inside one weighs nothing.

The models are compared by the log-likelihood ratio of a whole text: that of
every one of its words, summed and divided by the text's length. A logistic
curve, fitted on labelled texts that gave no counts, turns it into a score,
together with what words exceed LEVELS by, likewise summed and divided, so that
few toxic words stand out in a long text. A word whose first step no labelled
text has counts by what the classes back off by at the root.

Steps are told apart by 64-bit hashes. Their counts, distinct words before them
and path sums are tables that grow with the corpus and stay distributed. Two
tables of a fixed size go to all tasks: a bitmap of all steps and the ratios of
up to COMMON of the most frequent ones. A word whose deepest step in the bitmap
is a frequent one has its ratio there; other words meet the steps by a join. So
where a ratio is found depends on these sizes, but no score. Only sums over all
steps, those tables and the curve's rows reach the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm import words
from foliant.llm.storage import bitmap, cut, lean, marked, release, row_key, smallest

#: Bytes of the beginnings that a word's path leads through.
STEPS = (4, 6, 8)
#: Discount of the smaller class's counts.
DISCOUNT = 1.0
#: Log-ratios above which words speak for toxic.
LEVELS = (1.5, 3.5)
#: Folds of labelled rows: by crc32 of the id as text. The first is never learned from, the second calibrates.
FOLDS, HELD_OUT, CALIBRATE = 5, 0, 1
#: The curve is fitted on so many rows of its fold at most, those of the smallest hashes.
CURVE_ROWS = 20_000
#: Bits of the bitmaps of labelled ids (2 MB) and of steps (8 MB).
LABEL_BITS, STEP_BITS = 24, 26
#: The most frequent steps whose ratios all tasks have (24 MB).
COMMON = 1 << 20
#: Bytes of text at a time.
SLICE = 1 << 20


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo FOLDS; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


@dataclass
class Path:
    """Steps of all words of some texts: hashes of each step and of what it starts from (0: nothing), and which words take it; hashes of the words before."""

    words: words.Words
    steps: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    before: np.ndarray


def _path(raw: np.ndarray, offsets: np.ndarray) -> Path:
    w = words.split(raw, offsets, words.ALNUM)
    h = w.hashes()
    before = np.zeros_like(h)
    before[1:] = h[:-1]
    before[w.first[:-1][w.counts() > 0]] = np.uint64(0)
    size = w.end - w.start
    salts = words.mix(np.arange(2, len(STEPS) + 3, dtype=np.uint64))
    at = np.maximum(words.mix(w.hashes(STEPS[0]) ^ salts[0]), np.uint64(1))
    steps = [(at, np.zeros_like(h), size > 0)]
    # a later step's hash is its start's and that of its further bytes, by exclusive or, so that either two give the third
    for k, (n, to) in enumerate(zip(STEPS, [*STEPS[1:], None], strict=True), 1):
        further = words.Words(w.text, w.offsets, np.minimum(w.start + n, w.end), w.end, w.first).hashes(to and to - n)
        at = at ^ words.mix(further ^ salts[k])
        steps.append((at, steps[-1][0], size > n))
    return Path(w, steps, before)


def _counted(texts: DataFrame) -> DataFrame:
    """level, at, start, n0, n1, followed: for each step what it starts from, each class's count, and for first steps the number of distinct words before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False)
            for lo, hi, raw, offsets in words.slices(batch.column(0), SLICE):
                path = _path(raw, offsets)
                doc = np.repeat(np.arange(lo, hi), path.words.counts())
                for k, (at, start, takes) in enumerate(path.steps):
                    own, first, place = np.unique(at[takes], return_index=True, return_inverse=True)
                    once = np.unique(doc[takes] * max(len(own), 1) + place)
                    label = toxic[once // max(len(own), 1)]
                    n = [np.bincount(once[label == c] % max(len(own), 1), minlength=len(own)).astype(np.int64) for c in (0, 1)]
                    yield _rows(k, own, start[takes][first], None, *n)
                    if k == 0:
                        seen, which = np.unique(path.before, return_inverse=True)
                        pair = np.unique(place * max(len(seen), 1) + which)
                        none = np.zeros(len(pair), np.int64)
                        yield _rows(k, own[pair // max(len(seen), 1)], np.zeros(len(pair), np.uint64), seen[pair % max(len(seen), 1)], none, none)

    rows = texts.select("text", F.col("toxic").cast("int")).mapInArrow(lean(run), "level int, at long, start long, before long, n0 long, n1 long")
    # distinct pairs are dealt by all their parts first, as common words follow very many
    each = [F.sum(x).alias(x) for x in ("n0", "n1")]
    return rows.groupBy("level", "at", "start", "before").agg(*each).groupBy("level", "at", "start").agg(*each, F.count("before").alias("followed"))


def _rows(level: int, at: np.ndarray, start: np.ndarray, before: np.ndarray | None, n0: np.ndarray, n1: np.ndarray) -> pa.RecordBatch:
    prior = pa.nulls(len(at), pa.int64()) if before is None else pa.array(before.view(np.int64))
    columns = [pa.array(np.full(len(at), level, np.int32)), pa.array(at.view(np.int64)), pa.array(start.view(np.int64)), prior, pa.array(n0), pa.array(n1)]
    return pa.RecordBatch.from_arrays(columns, names=["level", "at", "start", "before", "n0", "n1"])


@dataclass
class Common:
    """Hashes of the most frequent steps, in order, and their ratios."""

    at: np.ndarray
    ended: np.ndarray
    failed: np.ndarray


@dataclass
class Model:
    """nodes: level, at, n (texts that have it), ended, failed of all steps, in the shared folder: log-ratios of words that end there and of those that go on unseen."""

    nodes: DataFrame
    bitmap: Broadcast
    common: Broadcast
    unseen: float  # log-ratio of words whose first step is none
    curve: np.ndarray  # intercept and weights of MARGINS


def _nodes(counted: DataFrame, pooled: bool = True) -> DataFrame:
    """The nodes of a model, and the root (level -1, at 0), where words fail that have no first step.

    By Kneser-Ney (pooled false, which models are made with), or with shares of
    both classes' counts in the place of later steps' continuation counts, and
    weights from those.
    """
    root = counted.where("start = 0")
    n0, n1, kinds, followed = root.agg(F.sum("n0"), F.sum("n1"), F.count("*"), F.sum("followed")).first()
    tokens = [max(1.0, float(n or 0)) for n in (n0, n1)]
    less = [F.greatest(F.col(f"n{c}") - F.lit(DISCOUNT * tokens[c] / min(tokens)), F.lit(0.0)) for c in (0, 1)]
    back = F.least(F.greatest(0.75 * F.col("kinds") / F.greatest("mass", F.lit(1)), F.lit(0.02)), F.lit(0.98))
    sums = [F.count("*").alias("kinds"), F.sum(F.col("n0") + F.col("n1")).alias("mass"), F.sum(less[0]).alias("t0"), F.sum(less[1]).alias("t1"), F.sum("n0").alias("m0"), F.sum("n1").alias("m1")]

    def weighed(of: DataFrame) -> DataFrame:
        if not pooled:  # a class's weight is the share of its counts that the discount took; without counts it backs off whole
            out = of.withColumns({f"back{c}": F.when(F.col(f"m{c}") > 0, 1 - F.col(f"t{c}") / F.col(f"m{c}")).otherwise(1.0) for c in (0, 1)})
            return out.withColumn("unseen", F.ln("back1") - F.ln("back0"))
        lost = [F.when(F.col(f"t{c}") > 0, F.ln("back")).otherwise(0.0) for c in (0, 1)]
        return of.withColumn("back", back).withColumn("unseen", lost[1] - lost[0])

    def ratio() -> Column:
        if not pooled:
            own = [less[c] / F.greatest(f"m{c}", F.lit(1)) + F.col(f"back{c}") * F.col("shared") for c in (0, 1)]
            return F.ln(own[1] / own[0])
        of = []
        for c in (0, 1):
            own = F.least(less[c] / F.greatest(f"t{c}", F.lit(1e-6)), F.lit(1.0))
            of.append(F.when(F.col(f"t{c}") > 0, (1 - F.col("back")) * own + F.col("back") * F.col("shared")).otherwise(F.col("shared")))
        return F.ln(of[1] / of[0])

    def stepped(rows: DataFrame, shared: Column) -> DataFrame:
        return rows.withColumn("shared", shared).withColumn("ratio", ratio()).select("level", "at", "start", (F.col("n0") + F.col("n1")).alias("n"), "ratio")

    # all first steps have one start, whose sums are numbers
    whole = weighed(root.agg(*sums)).first()
    numbers = ("t0", "t1", "back") if pooled else ("m0", "m1", "back0", "back1")
    first = root.withColumns({x: F.lit(float(whole[x] or 0)) for x in numbers})
    smooth = 0.5 if pooled else 0.0
    first = stepped(first, (F.col("followed") + smooth) / F.lit(float(followed or 0) + smooth * kinds))
    starts = cut(weighed(counted.where("start <> 0").groupBy("start").agg(*sums)), "starts")
    later, shared = counted.where("start <> 0"), (F.col("n0") + F.col("n1") + 0.5) / (F.col("mass") + 0.5 * F.col("kinds"))
    if not pooled:
        # a step is its start and further bytes, so that the steps with these bytes are the beginnings that they follow
        later = later.withColumn("further", F.col("at").bitwiseXOR(F.col("start")))
        all_of = {r["level"]: r["count"] for r in later.groupBy("level").count().collect()}
        of_level = F.coalesce(*(F.when(F.col("level") == k, float(n)) for k, n in all_of.items()), F.lit(1.0))
        follows = later.groupBy("level", "further").agg((F.count("*") / of_level).alias("continued"))
        later, shared = later.join(follows, ["level", "further"]), F.col("continued")
    later = stepped(later.join(starts, "start"), shared)
    unseen = starts.select(F.col("start").alias("at"), "unseen")
    steps = cut(first.unionByName(later).join(unseen, "at", "left").withColumn("unseen", F.coalesce("unseen", F.lit(0.0))), "ratios")

    def ratios(ended: Column) -> list[Column]:
        return [ended.alias("ended"), (ended + F.col("unseen")).alias("failed")]

    levels = [cut(steps.where("level = 0").select("level", "at", "n", *ratios(F.col("ratio"))), "level")]
    for k in range(1, len(STEPS) + 1):
        up = levels[-1].select(F.col("at").alias("start"), F.col("ended").alias("_up"))
        levels.append(cut(steps.where(F.col("level") == k).join(up, "start").select("level", "at", "n", *ratios(F.col("_up") + F.col("ratio"))), "level"))
    top = counted.sparkSession.range(1).select(F.lit(-1).alias("level"), F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("ended"), F.lit(float(whole["unseen"] or 0)).alias("failed"))
    nodes = cut(reduce(DataFrame.unionByName, [*levels, top]), "nodes")
    release(starts, steps, *levels)
    return nodes


def _fit(margins: np.ndarray, toxic: np.ndarray, rounds: int = 50, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a logistic regression by Newton steps, on standardised margins.

    A step is halved until the loss falls: margins that go together otherwise make steps of full length run in a circle.
    """
    mean, scale = margins.mean(axis=0), margins.std(axis=0) + 1e-9
    x = np.column_stack((np.ones(len(margins)), (margins - mean) / scale))
    w = np.zeros(x.shape[1])

    def loss(w: np.ndarray) -> float:
        return np.logaddexp(0, x @ w).sum() - toxic @ (x @ w) + ridge / 2 * (w @ w)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - toxic) + ridge * w
        bend = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        while np.abs(step).max() >= 1e-8 and loss(w - step) > loss(w):
            step = step / 2
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return np.concatenate(([w[0] - (w[1:] * mean / scale).sum()], w[1:] / scale))


def _common(nodes: DataFrame) -> Broadcast:
    """The most frequent steps, COMMON at most: those of a count that only so many have."""
    step = nodes.where("level >= 0").withColumn("_size", F.floor(8 * F.log2("n")))
    rows, least = 0, None
    for size, n in sorted(map(tuple, step.groupBy("_size").count().collect()), reverse=True):
        rows += n
        if rows > COMMON:
            break
        least = size
    found = step.where(F.lit(False) if least is None else F.col("_size") >= least).select("at", "ended", "failed").toArrow()
    at = found["at"].to_numpy().view(np.uint64)
    order = np.argsort(at)
    return nodes.sparkSession.sparkContext.broadcast(Common(at[order], found["ended"].to_numpy()[order], found["failed"].to_numpy()[order]))


#: What the curve weighs: the mean log-likelihood ratio of a text's words, and the logarithms of their mean excesses over LEVELS.
MARGINS = ("low", "high", "mean")
_ASKED = "_a long, _b long, word long, at long, last boolean, times long, size long, low double, high double, mean double"


def _margins(df: DataFrame, text: str, model: Model) -> DataFrame:
    """df with MARGINS, over all words of each text.

    Rows are told apart by hashes of their values, so that equal rows get equal
    results. Tasks that read texts sum up the words whose ratios they have (a
    row for each text, without a word); other words leave them, once for each
    text and step beyond those whose ratios are there, with the last of these
    (as mean), which counts if none of the steps is found.
    """
    keys = [F.xxhash64(F.col(f"`{text}`")).alias("_a"), row_key(df)[1]]
    steps, common, unseen = model.bitmap, model.common, model.unseen
    kinds = [pa.int64()] * 4 + [pa.bool_()] + [pa.int64()] * 2 + [pa.float64()] * 3

    def rows(*columns: np.ndarray | None) -> pa.RecordBatch:
        n = len(columns[0])
        return pa.RecordBatch.from_arrays([pa.nulls(n, kind) if x is None else pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in _ASKED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(k).to_numpy() for k in (1, 2))
            for lo, hi, raw, offsets in words.slices(batch.column(0), SLICE):
                path = _path(raw, offsets)
                counts = path.words.counts()
                # the words of the slice once, and those of each text once, with how often they stand there
                word, first, place = np.unique(path.words.hashes(), return_index=True, return_inverse=True)
                once, times = np.unique(np.repeat(np.arange(hi - lo), counts) * max(len(word), 1) + place, return_counts=True)
                doc, kind = once // max(len(word), 1), once % max(len(word), 1)
                # a word's ratio is that of the deepest step that there is
                ratio, known, deepest, asks = np.full(len(word), unseen), np.ones(len(word), bool), np.full(len(word), -1), []
                for k, (at, _, takes) in enumerate(path.steps):
                    at, takes = at[first], takes[first]
                    hit = takes & marked(steps.value, at, STEP_BITS)
                    last = np.ones(len(word), bool) if k + 1 == len(path.steps) else ~path.steps[k + 1][2][first]
                    near = np.minimum(np.searchsorted(common.value.at, at), max(len(common.value.at) - 1, 0))
                    held = hit & (common.value.at[near] == at) if len(common.value.at) else np.zeros(len(word), bool)
                    ratio[held] = np.where(last[held], common.value.ended[near[held]], common.value.failed[near[held]])
                    known = np.where(hit, held, known)
                    deepest[held] = k
                    asks.append((hit, at, last))
                mine = known[kind]
                sums = [np.bincount(doc[mine], x * times[mine], hi - lo) for r in (ratio[kind[mine]],) for x in (*(np.maximum(r - level, 0.0) for level in LEVELS), r)]
                some = np.flatnonzero(counts)
                yield rows(a[lo + some], b[lo + some], None, a[lo + some], None, None, counts[some], *(x[some] for x in sums))
                for k, (hit, at, last) in enumerate(asks):
                    ask = np.flatnonzero((hit & ~known & (k > deepest))[kind])
                    d, w = doc[ask], kind[ask]
                    yield rows(a[lo + d], b[lo + d], word[w].view(np.int64), at[w].view(np.int64), last[w], times[ask], counts[d], None, None, ratio[w])

    asked = df.select(F.col(f"`{text}`"), *keys).mapInArrow(lean(run), _ASKED)
    met = asked.join(model.nodes.select("at", "level", "ended", "failed").hint("merge"), "at", "left").withColumn("ratio", F.when(F.col("last"), F.col("ended")).otherwise(F.col("failed")))
    each = met.groupBy("_a", "_b", "word").agg(F.max_by("ratio", "level").alias("ratio"), *(F.max(x).alias(x) for x in ("times", "size", *MARGINS)))
    ratio = F.coalesce("ratio", "mean")
    own = {name: F.greatest(ratio - level, F.lit(0.0)) for name, level in zip(MARGINS, LEVELS, strict=False)} | {"mean": ratio}
    found = each.groupBy("_a", "_b").agg(*((F.sum(F.when(F.col("word").isNull(), F.col(x)).otherwise(own[x] * F.col("times"))) / F.max("size")).alias(x) for x in MARGINS))
    out = df.withColumns({"_a": keys[0], "_b": keys[1]}).join(found, ["_a", "_b"], "left").drop("_a", "_b")
    return out.withColumns({x: F.ln(F.coalesce(x, F.lit(0.0)) + 0.005) for x in ("low", "high")} | {"mean": F.coalesce("mean", F.lit(0.0))})


def _curve(margins: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """_fit(), with no weight for the mean (the last of the margins) if a higher one would speak against toxic."""
    curve = _fit(margins, toxic)
    return curve if curve[-1] >= 0 else np.append(_fit(margins[:, :-1], toxic), 0.0)


def _maybe_labelled(texts: DataFrame, known: DataFrame) -> DataFrame:
    """texts without most rows that known lacks, so that fewer are shuffled: by a bitmap of hashed ids of a fixed size."""
    shared = bitmap(known, "place", LABEL_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(marked(shared.value, batch.column("place").to_numpy().view(np.uint64), LABEL_BITS)))

    return texts.mapInArrow(lean(run), texts.schema)


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic") -> Model | float:
    """A model from the labelled documents outside the held-out fold, or the share of toxic ones if a class is missing.

    Counts come from all labelled rows of the other folds but one, on which
    the curve is fitted (CURVE_ROWS at most). Null labels are ignored; an id
    labelled twice is toxic if either label says so.
    """
    known = labels.where(F.col(toxic).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg((F.max(toxic) > 0).cast("int").alias("toxic"))
    known = cut(known.where(fold(F.col("doc_id")) != HELD_OUT).withColumn("place", F.xxhash64("doc_id")), "labels")
    texts = docs.where(fold(F.col(doc_id)) != HELD_OUT).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    texts = _maybe_labelled(texts.withColumn("place", F.xxhash64("doc_id")), known).select("doc_id", "text")
    # labels grow with the corpus: never broadcast them
    texts = texts.join(known.hint("merge"), "doc_id").select("text", "toxic", fold(F.col("doc_id")).alias("fold"), "place")
    texts = cut(texts, "labelled")
    counts = texts.where(F.col("fold") != CALIBRATE)
    n, positive = counts.agg(F.count("*"), F.sum("toxic")).first()
    fitted = smallest(texts.where(F.col("fold") == CALIBRATE), "place", CURVE_ROWS)
    if not n or positive in (0, n):
        release(texts, known)
        return positive / n if n else 0.0
    counted = cut(_counted(counts), "steps")
    nodes = _nodes(counted, pooled=False)
    unseen = nodes.where("level = -1").first()["failed"]
    model = Model(nodes, bitmap(nodes.where("level >= 0"), "at", STEP_BITS), _common(nodes), unseen, np.array([3.0, 0.0, 1.0, 1.0]))
    found = _margins(fitted.select("text", "toxic", "place"), "text", model).select(*MARGINS, "toxic").toArrow()
    margins, target = np.column_stack([found[x].to_numpy() for x in MARGINS]), found["toxic"].to_numpy().astype(float)
    release(texts, known, counted)
    if len(target) and 0 < target.sum() < len(target):
        model.curve = _curve(margins, target)
    return model


def toxicity(docs: DataFrame, model: Model | float, text: str = "text", score: str = "score") -> DataFrame:
    """docs with score double: 0 to 1, higher if a toxic label is likelier.

    Every whole text is scored; null and empty texts get the score of no
    evidence. All other columns pass; a column named score is replaced. docs is read twice
    and must give the same rows each time; the model's nodes are read with it.
    """
    if isinstance(model, float):
        return docs.withColumn(score, F.lit(model))
    others = {x: f"_{x}_{uuid.uuid4().hex}" for x in (*MARGINS, "_a", "_b") if x in docs.columns and x != score}
    kept = docs.drop(score).withColumnsRenamed(others)
    found = _margins(kept, others.get(text, text), model)
    at = reduce(Column.__add__, (float(w) * F.col(x) for w, x in zip(model.curve[1:], MARGINS, strict=True)), F.lit(float(model.curve[0])))
    scored = found.withColumn(score, 1 / (1 + F.exp(-F.least(F.greatest(at, F.lit(-30.0)), F.lit(30.0)))))
    names = {new: old for old, new in others.items()}
    return scored.select(*(F.col(f"`{x}`").alias(names.get(x, x)) for x in [*kept.columns, score]))
