"""Many terms in many texts: one pass of an automaton over each text.

Terms become a trie with failure links (Aho-Corasick), so that a text is read
once, whatever the number of terms. Very many terms are dealt to tries of
bounded size, with a pass for each.
"""

from __future__ import annotations

from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of the terms of one trie, about; the terms of one trie travel to the driver and, broadcast, to tasks.
TRIE_CHARS = 4_000_000

HITS = T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("place", T.IntegerType()), T.StructField("position", T.IntegerType())]))


def _trie(terms: list[str]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for term in terms:
        if term:
            out.add_word(term, (term, len(term)))
    out.make_automaton()
    return out


_tries: dict[int, ahocorasick.Automaton] = {}


def hits(trie: ahocorasick.Automaton, texts: list[str | None]) -> list[dict]:
    """For each term in any of the texts the first of them that has it, and where it begins there (from 1)."""
    found: dict[str, tuple[int, int]] = {}
    for place, text in enumerate(texts):
        if text and len(trie):
            here: dict[str, int] = {}
            for end, (term, size) in trie.iter(text):
                here.setdefault(term, end - size + 2)
            for term, position in here.items():
                found.setdefault(term, (place, position))
    return [{"term": t, "place": p, "position": at} for t, (p, at) in found.items()]


def with_terms(rows: DataFrame, columns: list[str], terms: DataFrame) -> DataFrame:
    """rows that have any of terms (its column term) in any of columns, with found: for each such term, place (of the first column that has it, from 0) and position (from 1) there.

    A row comes back once for each trie that finds terms in it. Null texts have
    no terms; the empty term is in every text that is not null, at 1.
    """
    spark, schema = rows.sparkSession, T.StructType([*rows.schema.fields, T.StructField("found", HITS)])
    asked = terms.select("term").where("term IS NOT NULL").distinct()
    chars = asked.agg(F.sum(F.length("term") + 1)).first()[0] or 0
    parts = -(-chars // TRIE_CHARS)
    if not parts:
        return rows.withColumn("found", F.array().cast(HITS)).where("false")
    out = []
    for part in range(parts):
        mine = asked if parts == 1 else asked.where(F.pmod(F.xxhash64("term"), F.lit(parts)) == part)
        out.append(rows.mapInArrow(_scan(spark.sparkContext.broadcast([r[0] for r in mine.collect()]), columns), schema))
    return reduce(DataFrame.unionByName, out)


def _scan(shared, columns: list[str]):
    kind = pa.list_(pa.struct([("term", pa.string()), ("place", pa.int32()), ("position", pa.int32())]))

    def scan(batches):
        key = shared.id if hasattr(shared, "id") else id(shared)
        if key not in _tries:  # a worker builds it once, and keeps no older one
            _tries.clear()
            _tries[key] = _trie(shared.value)
        trie, everywhere = _tries[key], "" in shared.value
        for b in batches:
            texts = [b.column(c).to_pylist() for c in columns]
            found = []
            for row in zip(*texts, strict=True):
                here = hits(trie, list(row))
                if everywhere and any(x is not None for x in row):
                    here.append({"term": "", "place": next(i for i, x in enumerate(row) if x is not None), "position": 1})
                found.append(here)
            keep = pa.array([bool(x) for x in found], pa.bool_())
            yield b.append_column("found", pa.array(found, kind)).filter(keep)

    return scan
