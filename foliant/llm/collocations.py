"""Phrase collocations, counted in quotient filters that are merged across shards.

Texts are cut into chunks, each coded with word numbers of its own. The chunks'
words are counted and those that are frequent enough get ids, which the chunks
take over by a join; a phrase with another word can't be frequent. Then, for
phrases of two words and more, every chunk puts its n-grams of ids into
quotient filters, one for each range of permuted keys (a shard). A shard's
filters are merged, its frequent n-grams go to the table of counts, and each
chunk learns which of its own n-grams they are: longer n-grams are only counted
where both their parts are frequent, which drops nothing. So no task sees more
than a chunk or a shard, and no vocabulary is ever sent to all tasks: Spark
judges written tables by their compressed files, before their copies are made,
so that joins of words and phrases say that they are merge joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.llm.places import placed
from foliant.llm.quotient import Keys, Layout, freeze, pack, summed, thaw, unpack
from foliant.llm.storage import cut, lean
from foliant.llm.words import slices, split

#: Bytes of words [^\x20\x09]+ in pieces
WORD = np.ones(256, dtype=bool)
#: Bytes [.,;:!?\x0A-\x0D] that end a piece
BREAK = np.zeros(256, dtype=bool)
BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
WORD[BREAK] = False
WORD[[0x20, 0x09]] = False

#: Bytes of text of a chunk; a longer text is a chunk by itself.
CHUNK = 8 << 20
#: Keys of a shard, about, before filters are merged.
SHARD = 1 << 20
#: Ids up to this, the most frequent words, are joined by so many copies.
HOT, COPIES = 4096, 16


def _narrow(codes: np.ndarray) -> bytes:
    """Numbers in two bytes each, or in four, which a first byte tells."""
    kind = np.uint16 if len(codes) == 0 or codes.max() < 1 << 16 else np.uint32
    return bytes([kind().nbytes]) + codes.astype(kind).tobytes()


def _codes(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint16 if data[0] == 2 else np.uint32, offset=1).astype(np.int64)


def coded(raw: np.ndarray, offsets: np.ndarray, langs: pa.Array) -> tuple[list[str], list[str], np.ndarray, np.ndarray]:
    """Languages, words and counts of a chunk's distinct (language, word), and its words as their numbers from 1, with 0 between pieces."""
    w = split(raw, offsets, WORD)
    if not len(w.start):
        return [], [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = w.end - w.start
    body = w.text[WORD[w.text]]
    texts = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(np.concatenate(([0], np.cumsum(size))).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(body)))
    texts = texts.dictionary_encode()
    langs = langs.dictionary_encode()
    text_of = np.repeat(np.arange(len(offsets) - 1), w.counts())
    both = langs.indices.to_numpy()[text_of].astype(np.int64) * len(texts.dictionary) + texts.indices.to_numpy()
    distinct, number, count = np.unique(both, return_inverse=True, return_counts=True)
    piece = np.searchsorted(np.flatnonzero(BREAK[w.text]), w.start) + text_of
    gaps = np.cumsum(np.concatenate(([0], piece[1:] != piece[:-1])))
    codes = np.zeros(len(size) + gaps[-1], np.int64)
    codes[np.arange(len(size)) + gaps] = number + 1
    lang, word = np.divmod(distinct, len(texts.dictionary))
    return langs.dictionary.take(pa.array(lang)).to_pylist(), texts.dictionary.take(pa.array(word)).to_pylist(), count, codes


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    chunk = TaskContext.get().partitionId() << 32
    for batch in batches:
        for lo, hi, raw, offsets in slices(batch.column("text"), CHUNK):
            langs, words, counts, codes = coded(raw, offsets, batch.column("lang").slice(lo, hi - lo))
            if len(codes):
                columns = [[chunk], [langs], [words], [counts.tolist()], [_narrow(codes)]]
                kinds = [pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=["chunk", "langs", "words", "counts", "codes"])
                chunk += 1


def squeezed(ids: np.ndarray) -> np.ndarray:
    """Ids without those that have no neighbour, and with one 0 between runs."""
    near = np.zeros(len(ids) + 1, bool)
    near[1:-1] = (ids[1:] > 0) & (ids[:-1] > 0)
    keep = near[1:] | near[:-1]
    return ids[keep | np.concatenate(([False], keep[:-1]))] if len(ids) else ids


class Grams:
    """The n-grams of a chunk that may be frequent, by the masks of shorter ones."""

    def __init__(self, ids: np.ndarray, bits: int, cut: int):
        self.ids, self.bits, self.cut = ids, bits, cut
        self.n, self.live = 1, np.flatnonzero(ids > 0)
        self.alive = ids > 0
        self.longer()

    def longer(self) -> None:
        """The keys of n-grams whose parts are alive."""
        self.n += 1
        self.layout = Layout(self.n, self.bits)
        self.live = np.flatnonzero(self.alive[:-1] & self.alive[1:]) if len(self.alive) else self.live
        keys = pack([self.ids[self.live + k] for k in range(self.n)], self.layout)
        self.keys, self.counts, self.place = summed(keys, None, self.layout)

    def shards(self) -> Iterator[tuple[int, slice]]:
        """Shards that have keys, and which."""
        cut = min(self.cut, self.layout.left)
        shard = self.keys.left >> np.uint64(self.layout.left - cut) if cut else np.zeros(len(self.keys), np.uint64)
        edges = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1], [True]))) if len(shard) else []
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            yield int(shard[lo]), slice(lo, hi)

    def sift(self, masks: dict[int, bytes]) -> None:
        """Keep n-grams that are frequent, and go on to longer ones."""
        frequent = np.zeros(len(self.keys), bool)
        for shard, at in self.shards():
            if shard in masks:
                frequent[at] = np.unpackbits(np.frombuffer(masks[shard], np.uint8))[: at.stop - at.start] == 1
        self.alive = np.zeros(max(0, len(self.ids) - self.n + 1), bool)
        self.alive[self.live[frequent[self.place]]] = True
        self.longer()

    def filters(self) -> Iterator[tuple[int, bytes]]:
        cut = min(self.cut, self.layout.left)
        for shard, at in self.shards():
            yield shard, freeze(self.keys[at], self.counts[at], self.layout, cut)


_FILTERS = pa.schema([("chunk", pa.int64()), ("ids", pa.binary()), ("shard", pa.int32()), ("filter", pa.binary())])


def _rows(chunk: int, grams: Grams, ids: bytes | None) -> pa.Table:
    found = list(grams.filters())
    n = len(found) + (ids is not None)
    columns = [[chunk] * n, [*([ids] if ids is not None else []), *[None] * len(found)], [*([None] if ids is not None else []), *(s for s, _ in found)], [*([None] if ids is not None else []), *(f for _, f in found)]]
    return pa.table([pa.array(x, k) for x, k in zip(columns, _FILTERS.types, strict=True)], schema=_FILTERS)


def _identified(bits: int, cut: int):
    """A chunk's words as ids, and its filters of pairs."""

    def run(chunk: pa.Table, words: pa.Table) -> pa.Table:
        if not chunk.num_rows or not words.num_rows:
            return _FILTERS.empty_table()
        codes = _codes(chunk.column("codes")[0].as_py())
        to = np.zeros(int(codes.max()) + 1, np.int64)
        to[words.column("pos").to_numpy() + 1] = words.column("id").to_numpy()
        ids = squeezed(to[codes])
        return _rows(chunk.column("chunk")[0].as_py(), Grams(ids, bits, cut), _narrow(ids)) if len(ids) else _FILTERS.empty_table()

    return run


def _lengthened(n: int, bits: int, cut: int):
    """A chunk's filters of n-grams, by the masks of shorter ones."""

    def run(chunk: pa.Table, masks: pa.Table) -> pa.Table:
        if not chunk.num_rows or not masks.num_rows:
            return _FILTERS.empty_table()
        grams = Grams(_codes(chunk.column("ids")[0].as_py()), bits, cut)
        rows = masks.select(["n", "shard", "mask"]).to_pylist()
        for k in range(2, n):
            grams.sift({r["shard"]: r["mask"] for r in rows if r["n"] == k})
        return _rows(chunk.column("chunk")[0].as_py(), grams, None)

    return run


def merge(n: int, bits: int, cut: int, least: int):
    """A shard's frequent n-grams, and for each chunk which of its own are."""
    layout = Layout(n, bits)
    cut = min(cut, layout.left)
    schema = pa.schema([("chunk", pa.int64()), ("shard", pa.int32()), ("mask", pa.binary()), ("words", pa.list_(pa.int64())), ("a", pa.int64())])

    def run(rows: pa.Table) -> pa.Table:
        shard = rows.column("shard")[0].as_py()
        thawed = [thaw(f, layout, cut, shard) for f in rows.column("filter").to_pylist()]
        keys = Keys(np.concatenate([k.left for k, _ in thawed]), np.concatenate([k.right for k, _ in thawed]))
        distinct, total, place = summed(keys, np.concatenate([c for _, c in thawed]), layout)
        frequent = total >= least
        of, edges = frequent[place], np.cumsum([0, *(len(k) for k, _ in thawed)])
        masks = [(c, np.packbits(of[lo:hi]).tobytes()) for c, lo, hi in zip(rows.column("chunk").to_pylist(), edges[:-1], edges[1:], strict=True) if of[lo:hi].any()]
        grams, counts = unpack(distinct[frequent], layout), total[frequent]
        none = [None] * len(counts)
        columns = [[*(c for c, _ in masks), *none], [*[shard] * len(masks), *none], [*(m for _, m in masks), *none], [*[None] * len(masks), *grams.tolist()], [*[None] * len(masks), *counts.tolist()]]
        return pa.table([pa.array(x, k) for x, k in zip(columns, schema.types, strict=True)], schema=schema)

    return run


def _copied(df: DataFrame) -> DataFrame:
    """Rows by id, the hot ones in copies, for _looked_up."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.when(F.col("id") <= HOT, COPIES - 1).otherwise(0))))


def _copy(key: str) -> Column:
    return F.when(F.col("id") <= HOT, F.pmod(F.xxhash64(key), F.lit(COPIES)).cast("int")).otherwise(0)


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 30, longest: int = 4) -> tuple[DataFrame, DataFrame, DataFrame]:
    """vocabulary (lang, word, f, id), phrases (words, an array of ids; a) and totals (lang, n): words and phrases of up to longest (4 at most) words with least occurrences, and all word occurrences.

    Phrases are told apart by language, as ids belong to one. Null texts are
    empty, a null language is "und".
    """
    given = docs.select(F.coalesce(F.col(f"`{lang}`"), F.lit("und")).alias("lang"), F.col(f"`{text}`").alias("text"))
    chunks = cut(given.mapInArrow(lean(_chunks), "chunk long, langs array<string>, words array<string>, counts array<long>, codes binary"), "chunks")
    entries = chunks.select("chunk", F.posexplode(F.arrays_zip("langs", "words", "counts")).alias("pos", "e")).select("chunk", "pos", "e.*")
    totals = cut(entries.groupBy(F.col("langs").alias("lang")).agg(F.sum("counts").alias("n")), "totals")
    counted = entries.groupBy(F.col("langs").alias("lang"), F.col("words").alias("word")).agg(F.sum("counts").alias("f")).where(F.col("f") >= least)
    counted = cut(counted.withColumn("_down", -F.col("f")), "counted")
    vocabulary = cut(placed(counted, ["_down", "lang", "word"]).select("lang", "word", "f", (F.col("place") + 1).alias("id")), "vocabulary")
    size, occurrences = vocabulary.agg(F.count("*"), F.sum("f")).first()
    bits, shards = max(1, int(size).bit_length()), max(0, (int(occurrences or 0) // SHARD).bit_length())
    if bits > 32:
        raise ValueError("more than 2**32 frequent words; raise least")

    # chunks take over ids; a word of many chunks is joined by copies
    lookups = entries.select("chunk", "pos", F.col("langs").alias("lang"), F.col("words").alias("word")).withColumn("copy", F.pmod("chunk", F.lit(COPIES)).cast("int"))
    known = vocabulary.select("lang", "word", "id", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))).alias("copy"))
    found = lookups.join(known.hint("merge"), ["lang", "word", "copy"]).select(F.col("chunk").alias("of"), "pos", "id")
    kind = "chunk long, ids binary, shard int, filter binary"
    filters = cut(chunks.select("chunk", "codes").groupBy("chunk").cogroup(found.groupBy("of")).applyInArrow(_identified(bits, shards), kind), "filters2")
    ids = filters.where("ids IS NOT NULL").select("chunk", "ids")
    phrases, masks = None, None
    for n in range(2, longest + 1):
        if n > 2:
            filters = cut(ids.groupBy("chunk").cogroup(masks.groupBy("chunk")).applyInArrow(_lengthened(n, bits, shards), kind), f"filters{n}")
        merged = filters.where("filter IS NOT NULL").select("chunk", "shard", "filter").groupBy("shard").applyInArrow(merge(n, bits, shards, least), "chunk long, shard int, mask binary, words array<long>, a long")
        merged = cut(merged, f"merged{n}")
        grams = merged.where("mask IS NULL").select("words", "a")
        phrases = grams if phrases is None else phrases.unionByName(grams)
        more = merged.where("mask IS NOT NULL").select("chunk", F.lit(n).alias("n"), "shard", "mask")
        masks = more if masks is None else masks.unionByName(more)
    return vocabulary, phrases, totals


def _exact(x: Column | str) -> Column:
    """A number in whose arithmetic products of 64-bit numbers stay exact."""
    return (F.col(x) if isinstance(x, str) else x).cast("decimal(20,0)")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 30, longest: int = 4, top: int = 2000, scale: int = 2_000_000, share: int = 80) -> DataFrame:
    """lang, rank int (from 1), phrase, a, l, r, n, score: each language's top phrases of two words and more.

    Texts are lower-cased (A-Z), cut to pieces at [.,;:!?\\x0A-\\x0D] and those
    to words [^\\x20\\x09]+. A phrase occurs a times; cut after its first words
    it has parts with l and r occurrences, and scores floor(scale * a / (l +
    r)); of its cuts the lowest score counts, of equal ones the earliest.
    Phrases inside a longer one that occurs at least share percent as often are
    left out. Ranks go by score and a, descending, then by the phrase's UTF-8
    bytes. Counts cover all texts, whole; long ones are chunks of their own,
    repeated rows count again, null texts are empty, the null language is
    "und". A table without frequent phrases has no rows; other columns play no
    part, whatever their names.
    """
    vocabulary, phrases, totals = frequent_phrases(docs, text, lang, least, longest)
    phrases = phrases.withColumn("size", F.size("words"))

    # all parts of two words and more of longer phrases, with their counts
    at = F.explode(F.expr("filter(flatten(transform(sequence(2, size - 1), k -> transform(sequence(1, size - k + 1), i -> struct(i AS at, k AS len)))), p -> p.len < size)"))
    parts = phrases.where("size > 2").withColumn("p", at).select("words", "a", "p.at", "p.len", F.expr("slice(words, p.at, p.len)").alias("part"))
    counts = phrases.select(F.col("words").alias("part"), F.col("a").alias("f"))
    parts = cut(parts.join(counts.hint("merge"), "part"), "parts")
    inside = parts.groupBy(F.col("part").alias("words")).agg(F.max("a").alias("longer"))
    left = phrases.join(inside.hint("merge"), "words", "left").where(F.col("longer").isNull() | (_exact("longer") * 100 < _exact("a") * share)).drop("longer")
    left = cut(left, "left")

    # their words: texts, counts and language
    words = left.select("words", F.posexplode("words").alias("i", "id")).withColumn("copy", _copy("words"))
    named = words.join(_copied(vocabulary).hint("merge"), ["id", "copy"]).groupBy("words").agg(F.first("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("i", "word", "f"))).alias("each"))
    of = parts.groupBy("words").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("at", "len"), "f"))).alias("of"))
    whole = left.join(named.hint("merge"), "words").join(of.hint("merge"), "words", "left")

    def counted(start: Column, length: Column) -> Column:
        return F.when(length == 1, F.element_at("each", start)["f"]).otherwise(F.element_at("of", F.struct(start.alias("at"), length.alias("len"))))

    cuts = F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda k: F.struct(k.alias("k"), counted(F.lit(1), k).alias("l"), counted(k + 1, F.col("size") - k).alias("r")))
    score = lambda c: F.call_function("div", _exact("a") * scale, _exact(c["l"]) + _exact(c["r"]))
    lowest = F.array_min(F.transform(cuts, lambda c: F.struct(score(c).cast("long").alias("score"), c["k"].alias("k"), c["l"].alias("l"), c["r"].alias("r"))))
    scored = whole.select("lang", F.array_join(F.col("each.word"), " ").alias("phrase"), "a", lowest.alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    scored = cut(scored, "scored")

    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    # the first of each of some parts of a language, so that a hot one is not sorted in one task
    some = scored.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    some = some.withColumn("_rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("_rank") <= top)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("int").alias("rank"), "phrase", "a", "l", "r", "n", "score")
