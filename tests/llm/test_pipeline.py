"""The pipeline's stages, each beside a plain computation on its own input."""

from collections import Counter

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as P
from foliant.llm import bpe, toxicity
from foliant.llm.queries import queries
from foliant.llm.storage import cut

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bad = spark.createDataFrame([(900001, None, "en", "a", 0), (900002, "", "en", "a", 0), (None, "The ordinary text of the town and the river.", "en", None, 1)], docs.schema)
    docs, columns = docs.unionByName(bad), docs.columns
    before = docs.collect()
    kept = []
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append(docs.collect())
    sure, clean, unique, mixed = kept
    assert {r.doc_id for r in before} - {r.doc_id for r in sure} == {900001, 900002}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    gone = {r.doc_id for r in sure} - {r.doc_id for r in clean}
    assert all(labels.get(d) != 0 for d in gone) or sum(labels.get(d) == 0 for d in gone) <= 0.05 * len(sure)
    sets = {}
    for r in clean:
        w = (r.text or "").lower().split()
        sets[r.doc_id] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)])
    ids = [r.doc_id for r in unique]
    assert len(ids) == len(set(ids))
    for a in ids:
        for b in ids:
            if a is not None and b is not None and a < b:
                assert 5 * len(sets[a] & sets[b]) < 4 * len(sets[a] | sets[b])
    assert all(any(5 * len(sets[d] & sets[e]) >= 4 * len(sets[d] | sets[e]) for e in sets if e != d and e is not None) for d in sets if d not in set(ids))
    assert max(Counter(r.doc_id for r in mixed).values()) <= 3
    assert {r.doc_id for r in mixed} <= set(ids)
    words = lambda rows: sum(len((r.text or "").split()) for r in rows)
    assert abs(words(mixed) - words(unique)) < 0.15 * words(unique)
    ranks = bpe.load(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).ranks
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    last = P.STAGES[-1][1](spark, docs, SF).collect()
    want = Counter((r.doc_id, len(theirs.encode_ordinary(r.text or ""))) for r in mixed)
    assert Counter((r.doc_id, r.n_tokens) for r in last) == want


def test_run_equals_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in P.STAGES:
        docs = cut(stage(spark, docs, SF), name)
    count = lambda df: Counter((r.doc_id, r.source, r.lang, r.n_tokens, bytes(r.token_ids), r.decoded_sha256) for r in df.collect())
    want = count(docs)
    assert want.total() > 100
    assert count(P.run(spark, SF)) == want


def test_queries_with_sql(spark):
    import duckdb

    from foliant.llm.queries import oracle_sql

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in oracle_sql().items():
        df = queries()[name](spark, SF)
        cursor = con.execute(sql)
        names = [c[0] for c in cursor.description]
        want = sorted(map(str, ([round(v, 6) if isinstance(v, float) else v for v in row] for row in cursor.fetchall())))
        got = sorted(map(str, ([round(v, 6) if isinstance(v, float) else v for v in row] for row in df.select(names).collect())))
        assert got == want, name


def test_contract_columns(spark):
    q = queries()
    tox = q["op5_toxicity"](spark, SF)
    assert tox.dtypes[:4] == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    lic = q["op6_licenses"](spark, SF)
    assert [c for c, _ in lic.dtypes] == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    assert lic.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert tox.where(F.col("held_out") != (toxicity.fold(F.col("doc_id")) == 0)).count() == 0


def test_media_query_beside_plain_bytes(spark):
    import hashlib
    import zlib

    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    out = {r.doc_id: r for r in queries()["op4_media"](spark, SF).collect()}
    assert len(out) == len(docs)
    for d in docs:
        data = (d.text or "").encode()
        payload = data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))
        r = out[d.doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_bytes > r.payload_bytes and len(r.media_sha256) == 64
    same = {}
    for d in docs:
        same.setdefault(d.text, set()).add((out[d.doc_id].media_sha256, out[d.doc_id].feature))
    assert all(len(x) == 1 for x in same.values())


def test_license_query_beside_plain_words(spark):
    import re

    from foliant.llm.licenses import BASE

    out = {r.doc_id: r for r in queries()["op6_licenses"](spark, SF).collect()}
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in d.text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
        places = [(i, label) for phrase, label in BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        r = out[d.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
        assert 0 <= r.score <= 1


def test_stages_on_no_rows_and_on_repeated_ids(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = " ".join(f"word{i}" for i in range(30))
    rows = [(1, text, "en", "a", 1), (1, text, "en", "a", 1), (1, "quite another text of the town " * 4, "en", "a", 2), (None, text, "en", "b", 1), (2, text + " more", "en", "a", 3), (3, None, "en", None, 0), (3, None, "en", None, 0)]
    df = spark.createDataFrame(rows, docs.schema)
    unique = P.near_duplicates(spark, df, SF).collect()
    assert sorted((r.doc_id or 0, r.n_chars) for r in unique) == [(1, 1), (1, 2), (3, 0)]
    for _, stage in P.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_queries_leave_their_result_alone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("foliant.llm.storage.LOCAL_DEFAULT", f"file://{tmp_path}/cut")
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        df = queries()["op10_mixing"](spark, SF)
        assert [p.name.rsplit("-", 1)[0] for p in (tmp_path / "cut").iterdir()] == ["op10_mixing"]
        assert df.count() > 0
