"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import bpe, collocations, itq, jaccard, language, licenses, media, merkle, mixing, topk, toxicity, urls, warc
from foliant.llm.storage import cut, swept

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tidy(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """query with its result written, and everything deleted that it wrote on the way."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with swept() as keep:
            return keep(cut(query(spark, sf_dir), query.__name__))

    return run


@tidy
def op1_itq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_duplicates(table(spark, sf_dir, "embeddings"))


@tidy
def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by text and source, then pages by text, markup and address; either id is null."""
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs)
    found = language.identify(docs.select("doc_id", "source", "text"), model, host=F.col("source"))
    columns = ["language", "confidence", "text_language", "accepted"]
    pages, evidence = language.page_evidence(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    on_pages = language.identify(pages, model, **evidence)
    null = F.lit(None).cast("long")
    return found.select("doc_id", null.alias("page_id"), *columns).unionByName(on_pages.select(null.alias("doc_id"), "page_id", *columns))


@tidy
def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), rule=jaccard.Rule(4, 85, 100))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.store(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    read = media.probe(stored)
    ranges = F.transform("keyframes", lambda k: F.concat_ws("-", k["start"].cast("string"), k["end"].cast("string")))
    feature = F.concat_ws(";", F.trim("codec"), F.col("timescale").cast("string"), F.col("duration").cast("string"), F.col("n_samples").cast("string"), F.array_join(ranges, ","))
    own = [F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature")]
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", *own)


@tidy
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.toxicity(docs, model)
    held_out = toxicity.fold(F.col("doc_id")) == toxicity.HELD_OUT
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    starts = F.transform("base", lambda b: b["start"])
    named = lambda *spans: F.array_join(F.array_sort(F.array_distinct(F.concat(*(F.transform(s, lambda b: b["label"]) for s in spans)))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        named("base").alias("base_labels"),
        named("base", "detections").alias("labels"),
        "score",
    )


URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


@tidy
def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return urls.filter_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


#: Without canonical links and refreshes, which the tables do not have; the tests cover them.
OP7_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), r AS (
  SELECT * FROM (VALUES ('allow', 'org/'), ('block', 'example.org/es/'), ('block', 'example.org/en/1'), ('allow', 'com/fr/'), ('block', 'com/de/')) v(verdict, rule)
), m AS (
  SELECT p.page_id, p.host, p.path, r.rule, r.verdict
  FROM p LEFT JOIN r ON (p.host = split_part(r.rule, '/', 1) OR ends_with(p.host, '.' || split_part(r.rule, '/', 1)))
                    AND starts_with(p.path, substr(r.rule, strpos(r.rule, '/')))
)
SELECT page_id, host, path, max_by(rule, length(rule)) AS rule, coalesce(max_by(verdict, length(rule)), 'allow') AS verdict
FROM m GROUP BY page_id, host, path
"""


@tidy
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything returned is read back from the normalised archives; a revisit's payload is its response's."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    marked = warc.dedup(pages, "page_id", "html")
    rows = marked.select(
        warc.record_id(F.col("page_id")).alias("record_id"),
        "record_type",
        F.col("url").alias("target_uri"),
        "payload_digest",
        F.when(F.col("refers_to").isNotNull(), warc.record_id(F.col("refers_to"))).alias("refers_to"),
        F.encode("html", "UTF-8").alias("payload"),
    )
    index = warc.normalise(warc.write_monolithic(rows))
    found = warc.read(index).select(
        warc.key_of(F.col("record_id"), "long").alias("page_id"),
        F.length("payload").cast("long").alias("own_bytes"),
        F.when(F.col("record_type") == "response", F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        F.when(F.col("refers_to").isNotNull(), warc.key_of(F.col("refers_to"), "long")).alias("refers_to"),
    )
    found = cut(found, "records")
    wanted = found.where("record_type = 'revisit'").select(F.col("refers_to").alias("_of")).distinct()
    sizes = found.where("record_type = 'response'").select(F.col("page_id").alias("_of"), "own_bytes").join(wanted, "_of", "left_semi")
    sizes = cut(sizes.groupBy("_of").agg(F.max("own_bytes").alias("_bytes")), "sizes")
    out = found.join(sizes, F.col("refers_to") == F.col("_of"), "left")
    n = F.when(F.col("record_type") == "response", F.col("own_bytes")).otherwise(F.col("_bytes"))
    return out.select("page_id", n.alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


OP8_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode_texts(docs, RANKS, public_tokenizers.PATTERN).drop("text")
    decoded = bpe.decode_ids(coded, RANKS, public_tokenizers.PATTERN)
    return decoded.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@tidy
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"))
    mixed = mixing.mix(docs, "size")
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM d GROUP BY source
), o AS (
  SELECT *, 3 * source_size AS cap, row_number() OVER (ORDER BY 3 * source_size / weight, source NULLS LAST) AS k FROM s
), p AS (
  SELECT *, sum(source_size) OVER () AS total, sum(cap) OVER (ORDER BY k) - cap AS cap_before, sum(weight) OVER (ORDER BY k DESC) AS weight_left FROM o
), l AS (
  SELECT min_by(CAST(total - cap_before AS DOUBLE) / weight_left, k) AS level FROM p WHERE cap >= CAST(total - cap_before AS DOUBLE) / weight_left * weight
), t AS (
  SELECT source, source_size, CASE WHEN level IS NULL THEN CAST(cap AS DOUBLE) ELSE least(CAST(cap AS DOUBLE), level * weight) END AS target FROM o, l
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         row_number() OVER (PARTITION BY d.source ORDER BY lpad(CAST(length(bin(d.size)) AS VARCHAR), 2, '0') || substr(bin(d.size), 1, 3) DESC,
                            md5(CAST(d.doc_id AS VARCHAR)) NULLS LAST, d.doc_id NULLS LAST) - 1 AS rank,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
         CAST(CAST('0x' || substr(md5('0:' || coalesce(d.source, '')), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0::DOUBLE AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, CAST(floor((rank + 1) * rate + start) - floor(rank * rate + start) AS BIGINT) * size AS taken FROM r
"""


@tidy
def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    # products beyond the range of doubles are as good as infinite
    whole = F.transform("embedding", lambda x: F.when(~F.isnan(x) & (F.abs(256 * x.cast("double")) != float("inf")), F.floor(256 * x.cast("double"))))
    return topk.top_k(rows, whole, F.col("vec_id") % 50 == 0, k=5)


OP11_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


MANIFEST_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


@tidy
def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*MANIFEST_FIELDS)
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    changed = F.when(tampered, merkle.digest(*(F.col(x) for x in MANIFEST_FIELDS[:-1]), lower))
    found = merkle.manifest(docs, MANIFEST_FIELDS, changed=changed)
    folded = merkle.fold(F.col("found"), F.col("path"))
    out = found.select("doc_id", "leaf", "subroot", "root", merkle.siblings_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


OP12_SQL = r"""
WITH RECURSIVE d AS (
  SELECT coalesce('=' || source, '-') AS tree, doc_id, text, -- null sources first
         coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
         || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars, '-') AS head
  FROM documents
), c AS (
  -- CRC-32, bit by bit
  SELECT tree, doc_id, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
         sha256(head || coalesce(octet_length(encode(text)) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) AS lower_leaf,
         xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(range(1, 1 + length(CAST(doc_id AS VARCHAR))),
             lambda i: list_transform(range(0, 8), lambda b: (CAST(ascii(substr(CAST(doc_id AS VARCHAR), CAST(i AS BIGINT), 1)) AS BIGINT) >> CAST(b AS INTEGER)) & 1)))),
             lambda crc, bit: xor(crc >> 1, 3988292384 * (xor(crc, bit) & 1))), 4294967295) % 5 = 0 AS tampered
  FROM d
), l AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY tree) AS n FROM c
), nodes AS (
  SELECT tree, 0 AS level, place AS pos, n, leaf AS node FROM l
  UNION ALL
  SELECT tree, level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(node, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY tree, level, pos // 16, n
), subroots AS (
  SELECT tree, node AS subroot, level AS height, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1
), tops AS (
  SELECT 0 AS level, pos, n, subroot AS node FROM subroots
  UNION ALL
  SELECT level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(node, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY level, pos // 16, n
), everywhere AS (
  -- each document's ancestors: their runs, and their own places in them
  SELECT l.tree, l.place, k.level, CAST(l.place // CAST(16 ** k.level AS BIGINT) AS BIGINT) AS pos, FALSE AS top
  FROM l JOIN (SELECT DISTINCT tree, level, n FROM nodes) k ON l.tree = k.tree AND k.n > 1
  UNION ALL
  SELECT l.tree, l.place, s.height + k.level, CAST(s.pos // CAST(16 ** k.level AS BIGINT) AS BIGINT), TRUE
  FROM l JOIN subroots s ON l.tree = s.tree JOIN (SELECT DISTINCT level, n FROM tops) k ON k.n > 1
), around AS (
  SELECT e.tree, e.place, e.level, coalesce(string_agg(x.node, '' ORDER BY x.pos) FILTER (x.pos < e.pos), '') AS before, coalesce(string_agg(x.node, '' ORDER BY x.pos) FILTER (x.pos > e.pos), '') AS after
  FROM everywhere e JOIN subroots s ON e.tree = s.tree
  JOIN (SELECT tree, level, pos, node, FALSE AS top FROM nodes UNION ALL SELECT s.tree, s.height + t.level, t.pos, t.node, TRUE FROM tops t, subroots s) x
    ON x.tree = e.tree AND x.level = e.level AND x.top = e.top AND x.pos // 16 = e.pos // 16
  GROUP BY e.tree, e.place, e.level
), folds AS (
  SELECT tree, place, 0 AS level, CASE WHEN tampered THEN lower_leaf ELSE leaf END AS node FROM l
  UNION ALL
  SELECT f.tree, f.place, f.level + 1, sha256(a.before || f.node || a.after) FROM folds f JOIN around a ON a.tree = f.tree AND a.place = f.place AND a.level = f.level
), folded AS (
  SELECT tree, place, max_by(node, level) AS folded_root FROM folds GROUP BY tree, place
), p AS (
  SELECT tree, place, sha256(string_agg(before || after, '' ORDER BY level)) AS proof_sha256 FROM around GROUP BY tree, place
)
SELECT l.doc_id, l.leaf, s.subroot, t.node AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, f.folded_root, f.folded_root = t.node AS verified
FROM l JOIN subroots s ON l.tree = s.tree JOIN tops t ON t.n = 1 JOIN folded f ON f.tree = l.tree AND f.place = l.place LEFT JOIN p ON p.tree = l.tree AND p.place = l.place
"""


@tidy
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), least=30, top=2000)


OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS piece
  FROM documents
), numbered AS (
  SELECT lang, row_number() OVER () AS piece, regexp_extract_all(piece, '[^ 	]+') AS words FROM pieces
), words AS (
  SELECT lang, piece, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM numbered
), runs AS (
  SELECT lang, w AS w1, lead(w) OVER p AS w2, lead(w, 2) OVER p AS w3, lead(w, 3) OVER p AS w4 FROM words WINDOW p AS (PARTITION BY piece ORDER BY i)
), f AS (
  SELECT lang, [w1] AS ws, count(*) AS a FROM runs GROUP BY lang, w1 UNION ALL
  SELECT lang, [w1, w2], count(*) FROM runs WHERE w2 IS NOT NULL GROUP BY lang, w1, w2 UNION ALL
  SELECT lang, [w1, w2, w3], count(*) FROM runs WHERE w3 IS NOT NULL GROUP BY lang, w1, w2, w3 HAVING count(*) >= 30 UNION ALL
  SELECT lang, [w1, w2, w3, w4], count(*) FROM runs WHERE w4 IS NOT NULL GROUP BY lang, w1, w2, w3, w4 HAVING count(*) >= 30
), n AS (
  SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE len(ws) = 1 GROUP BY lang
), c AS (
  SELECT * FROM f WHERE len(ws) > 1 AND a >= 30
), inside AS (
  SELECT DISTINCT c.lang, c.ws FROM c
  JOIN (SELECT lang, ws, a, unnest(range(2, len(ws))) AS k FROM c) o ON o.lang = c.lang AND len(c.ws) = o.k
  WHERE 100 * CAST(o.a AS HUGEINT) >= 80 * CAST(c.a AS HUGEINT)
    AND (c.ws = o.ws[1:o.k] OR c.ws = o.ws[2:o.k + 1] OR len(o.ws) = 4 AND c.ws = o.ws[3:o.k + 2])
), cuts AS (
  SELECT c.lang, c.ws, c.a, unnest(range(1, len(c.ws))) AS k FROM c ANTI JOIN inside USING (lang, ws)
), scored AS (
  SELECT t.lang, t.ws, t.a, l.a AS l, r.a AS r, CAST(2000000 * CAST(t.a AS HUGEINT) // (l.a + r.a) AS BIGINT) AS score,
         row_number() OVER (PARTITION BY t.lang, t.ws ORDER BY 2000000 * CAST(t.a AS HUGEINT) // (l.a + r.a), t.k) AS nth
  FROM cuts t JOIN f l ON l.lang = t.lang AND l.ws = t.ws[1:t.k] JOIN f r ON r.lang = t.lang AND r.ws = t.ws[t.k + 1:len(t.ws)]
), ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(ws, ' ')) AS rank, array_to_string(ws, ' ') AS phrase, a, l, r, score FROM scored WHERE nth = 1
)
SELECT lang, CAST(rank AS INTEGER) AS rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_itq": op1_itq, "op2_language": op2_language, "op3_jaccard": op3_jaccard, "op4_media": op4_media, "op5_toxicity": op5_toxicity, "op6_licenses": op6_licenses, "op7_urls": op7_urls, "op8_warc": op8_warc, "op9_bpe": op9_bpe, "op10_mixing": op10_mixing, "op11_topk": op11_topk, "op12_merkle": op12_merkle, "op13_collocations": op13_collocations}


def oracle_sql() -> dict[str, str]:
    return {"op7_urls": OP7_SQL, "op8_warc": OP8_SQL, "op10_mixing": OP10_SQL, "op11_topk": OP11_SQL, "op12_merkle": OP12_SQL, "op13_collocations": OP13_SQL}
