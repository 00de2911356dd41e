"""Language identification by Bayesian evidence fusion.

A row's posterior over languages multiplies
* the likelihood of its text, from byte trigrams (tempered, as trigrams overlap);
* the likelihood of the language that its markup declares;
* the likelihood of its address suffix (top-level domain);
* the prior of its host, smoothed towards its domain's and that towards the
  prior of all rows.

The text model is fitted on a bounded sample of rows of each known language.
Beside the languages stands UNKNOWN, the letters of all of them in no order: a
text that no language explains better is of none, rather than of the nearest.
Everything else is estimated over all rows by grouped aggregation, with the
language that the text alone suggests. Only tables of a fixed number of
buckets for each language reach the driver; counts by host, domain and suffix
stay distributed and are joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm import words
from foliant.llm.storage import cut, lean, release

#: The text model is fitted on about so many labelled rows of each language, by hashes of their ids; on all of a language that has fewer.
SAMPLE_ROWS = 1_000
#: What a text of none of the known languages gets.
UNKNOWN = "und"
#: Buckets of trigrams: 2**16 float32, a quarter of a MB, for each language.
GRAM_BITS = 16
#: log P(trigram) if all are as likely.
EVEN = -GRAM_BITS * np.log(2)
#: Bytes whose likelihoods are summed at a time.
BLOCK = 1 << 18
#: Languages whose tables a worker holds (256 MB of counts while it trains).
MOST_LANGUAGES = 512
#: A value of more than this share of all rows is hot: there are fewer than its reciprocal of them.
HOT_SHARE = 1 / 1024
#: Parts that rows of hot values, and those without one, are dealt to.
SPREAD = 1024
#: Trigrams that weigh as one independent observation.
TEMPER = 4.0
#: Rows that a level's own counts must have to weigh as much as the level above.
STRENGTH = 50.0
#: A posterior below this is no decision.
SURE = 0.6

_LETTERS = words.LOWER.copy()
_LETTERS[[c for c in range(128) if not chr(c).isalpha()]] = 0x20


def _grams(raw: np.ndarray) -> np.ndarray:
    """Bucket of the trigram that starts at each byte but the last two; runs of other bytes than letters are blanks."""
    b = _LETTERS[raw].astype(np.uint32)
    h = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D))
    h *= np.uint32(0x27D4EB2F)
    return (h >> np.uint32(32 - GRAM_BITS)).astype(np.int32)


def _ends(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and behind the last trigram of each text."""
    return offsets[:-1], np.maximum(offsets[1:] - 2, offsets[:-1])


class TextModel:
    """log P(trigram | language) in language order; for UNKNOWN, the last, the sum of log P(byte) of its bytes, or EVEN if that is more."""

    def __init__(self, languages: list[str], table: np.ndarray, letters: np.ndarray):
        self.languages, self.table, self.letters = [*languages, UNKNOWN], table, letters

    def log_likelihoods(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each text and language, and each text's number of trigrams."""
        first, end = _ends(offsets)
        out = np.zeros((len(first), len(self.languages)))
        for lo in range(0, max(len(raw) - 2, 0), BLOCK):
            part = raw[lo : lo + BLOCK + 2]
            total = np.zeros((len(part) - 1, len(self.languages)))
            np.cumsum(self.table[_grams(part)], axis=0, out=total[1:, :-1], dtype=np.float64)
            one = self.letters[_LETTERS[part]]
            np.cumsum(np.maximum(one[:-2] + one[1:-1] + one[2:], EVEN), out=total[1:, -1])
            out += total[np.clip(end - lo, 0, len(total) - 1)] - total[np.clip(first - lo, 0, len(total) - 1)]
        return out, end - first


def train(rows: DataFrame, text: str = "text", language: str = "lang", key: str = "doc_id") -> TextModel:
    """Fit the text model on rows whose language is known; null languages, UNKNOWN and empty texts are left out.

    About SAMPLE_ROWS of each language count, however rare it is; rows of one
    key stand or fall together. Labels of more than MOST_LANGUAGES languages are
    an error, as no worker holds their tables.
    """
    known = rows.where(F.col(language).isNotNull() & (F.col(language) != UNKNOWN) & (F.length(text) > 0))
    known = known.select(F.col(text).alias("text"), F.col(language).alias("language"), F.xxhash64(F.col(key).cast("string")).alias("place"))
    counts = cut(known.groupBy("language").agg((SAMPLE_ROWS / F.count("*")).alias("rate")), "counts")
    sample = cut(known.join(counts, "language").where(F.pmod("place", F.lit(1 << 30)) < F.col("rate") * (1 << 30)).select("text", "language"), "sample")
    languages = sorted(r[0] for r in counts.select("language").limit(MOST_LANGUAGES + 1).collect())
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"{language} has more than {MOST_LANGUAGES} languages: clear what is none, or train on fewer")
    place = {x: i for i, x in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((len(place), 1 << GRAM_BITS), np.int64)
        letters = np.zeros(256, np.int64)
        for batch in batches:
            named = batch.column(1).to_pylist()
            for lo, _, raw, offsets in words.slices(batch.column(0)):
                letters += np.bincount(_LETTERS[raw], minlength=256)
                grams = _grams(raw) if len(raw) > 2 else np.zeros(0, np.int32)
                for i, (a, z) in enumerate(zip(*_ends(offsets), strict=True)):
                    n[place[named[lo + i]]] += np.bincount(grams[a:z], minlength=1 << GRAM_BITS)
        k, at = np.nonzero(n)
        k, at, count = np.append(k, np.full(256, -1)), np.append(at, np.arange(256)), np.append(n[k, at], letters)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(count)], names=["k", "at", "n"])

    found = sample.mapInArrow(lean(run), "k int, at int, n long").groupBy("k", "at").agg(F.sum("n").alias("n")).toArrow()
    release(sample, counts)
    k, at, count = (found[x].to_numpy() for x in ("k", "at", "n"))
    n, letters = np.zeros((len(languages), 1 << GRAM_BITS)), np.full(256, 0.1)
    n[k[k >= 0], at[k >= 0]] = count[k >= 0]
    letters[at[k < 0]] += count[k < 0]
    p = (n + 0.1) / (n + 0.1).sum(axis=1, keepdims=True)
    return TextModel(languages, np.log(p.T).astype(np.float32).copy(), np.log(letters / letters.sum()))


def _likelihoods(df: DataFrame, text: str, model: TextModel) -> DataFrame:
    """df without its text, with _n (trigrams), _ll (array of log-likelihoods)."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in df.schema if f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, offsets in words.slices(batch.column(0)):
                ll, n = shared.value.log_likelihoods(raw, offsets)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * ll.shape[1]), pa.array(ll.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns[1:], pa.array(n.astype(np.int64)), flat], names=[*(f.name for f in kept), "_n", "_ll"])

    schema = T.StructType([*kept, T.StructField("_n", T.LongType()), T.StructField("_ll", T.ArrayType(T.DoubleType()))])
    return df.select(text, *(f"`{f.name}`" for f in kept)).mapInArrow(lean(run), schema)


def _counts(rows: DataFrame, key: str, languages: list[str]) -> DataFrame:
    """key, n_<key>: number of rows for each language by what the text suggests."""
    each = F.array(*(F.count(F.when(F.col("_best") == i, 1)).cast("double") for i in range(len(languages))))
    return cut(rows.where(F.col(key).isNotNull() & (F.col("_n") > 0)).groupBy(key).agg(each.alias(f"n{key}")), "counts")


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _with_counts(rows: DataFrame, key: str, counts: DataFrame, total: float) -> DataFrame:
    """rows with the counts of their key (see _counts), null without any.

    Hot keys are few by their share of all rows, so that their counts are
    broadcast. Other counts are joined by key, beside which the rows that have
    theirs already, or no key, are spread over all tasks.
    """
    own, hot = f"n{key}", _total(F.col(f"n{key}")) > total * HOT_SHARE
    rows = rows.join(F.broadcast(counts.where(hot)), key, "left")
    plain = [f"`{f.name}`" for f in rows.schema if isinstance(f.dataType, T.AtomicType) and not isinstance(f.dataType, T.VariantType)]
    settled = F.col(key).isNull() | F.col(own).isNotNull()
    rows = rows.withColumn("_part", F.when(settled, F.pmod(F.xxhash64("_ll", *plain), F.lit(SPREAD))).otherwise(-1))
    rest = counts.where(~hot).select(key, F.lit(-1).cast("long").alias("_part"), F.col(own).alias("_rest"))
    return rows.join(rest, [key, "_part"], "left").withColumn(own, F.coalesce(own, "_rest")).drop("_part", "_rest")


def _smoothed(own: str, above: Column) -> Column:
    """Shares of own counts, with the distribution above as STRENGTH further rows; above alone where there are none."""
    mixed = F.zip_with(own, above, lambda n, p: (n + STRENGTH * p) / (_total(F.col(own)) + STRENGTH))
    return F.coalesce(mixed, above)


def identify(df: DataFrame, model: TextModel, text: str = "text", host: Column | None = None, domain: Column | None = None, suffix: Column | None = None, declared: Column | None = None) -> DataFrame:
    """df without its text, with language, confidence (its posterior), text_language and accepted.

    Whole texts count, whatever their length. Null or unknown evidence is no
    evidence. Where neither text, markup nor suffix say anything, the language
    follows the prior and accepted is false; it is true if there is text
    evidence, the language is a known one and confidence is SURE at least. Of
    languages of equal posterior the first in code-point order wins. Repeated
    rows stay, each with the same result. Columns of the added names are
    replaced. Texts are read once; df's other columns are written beside their
    likelihoods, so leave out large ones.
    """
    languages = model.languages
    none = F.lit(None).cast("string")
    df = df.drop("language", "confidence", "text_language", "accepted").withColumns({"_host": none if host is None else host, "_domain": none if domain is None else domain, "_suffix": none if suffix is None else suffix})
    primary = F.regexp_extract(F.lower(none if declared is None else declared), r"^\s*([a-z]{2,3})\b", 1)
    df = df.withColumn("_declared", F.when(primary.isin(languages), primary).when(primary != "", F.lit("other")))
    keys = ("_host", "_domain", "_suffix", "_declared")
    best = (F.array_position("_ll", F.array_max("_ll")) - 1).cast("int").alias("_best")
    rows = first = cut(_likelihoods(df, text, model).select("*", best), "evidence")
    seen = first.where("_n > 0").agg(*(F.count(F.when(F.col("_best") == i, 1)) for i in range(len(languages)))).first()
    of = [float(x or 0) for x in seen]
    prior = F.array(*(F.lit((x + 1.0) / (sum(of) + len(of))) for x in of))
    for key in keys:
        rows = _with_counts(rows, key, _counts(first.select(key, "_best", "_n"), key, languages), sum(of))
    size = F.array(*map(F.lit, of))

    def likelihood(own: str) -> Column:
        share = _total(F.col(own)) / max(sum(of), 1.0)
        return F.coalesce(F.zip_with(own, size, lambda n, m: F.ln((n + STRENGTH * share) / (m + STRENGTH))), F.array(*(F.lit(0.0) for _ in of)))

    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    logs = add(F.transform("_ll", lambda x: x / TEMPER), F.transform(_smoothed("n_host", _smoothed("n_domain", prior)), lambda p: F.ln(p)))
    rows = rows.withColumn("_log", add(add(logs, likelihood("n_declared")), likelihood("n_suffix")))
    rows = rows.withColumn("_top", F.array_max("_log"))
    names = F.array(*map(F.lit, languages))
    confidence = 1.0 / _total(F.transform("_log", lambda x: F.exp(x - F.col("_top"))))
    rows = rows.withColumns({
        "language": F.element_at(names, F.array_position("_log", F.col("_top")).cast("int")),
        "confidence": confidence,
        "text_language": F.when(F.col("_n") > 0, F.element_at(names, F.col("_best") + 1)),
    })
    rows = rows.withColumn("accepted", (F.col("_n") > 0) & (F.col("confidence") >= SURE) & (F.col("language") != UNKNOWN))
    return rows.drop("_host", "_domain", "_suffix", "_declared", "_n", "_ll", "_best", "n_host", "n_domain", "n_suffix", "n_declared", "_log", "_top")


def page_evidence(pages: DataFrame, url: str = "url", html: str = "html") -> tuple[DataFrame, dict[str, Column]]:
    """pages with text (markup, scripts and styles removed) instead of html, and the evidence for identify()."""
    lang = F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", 1)
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[a-z0-9#]+;", " ")
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[^:/?#]*://([^/?#]*)", 1)), r"^.*@|:\d*$", "")
    host = F.when(host != "", host)
    rows = pages.withColumns({"_lang": F.when(lang != "", lang), "text": text, "_name": host}).drop(html)
    name = F.col("_name")
    return rows, {"host": name, "domain": F.substring_index(name, ".", -2), "suffix": F.substring_index(name, ".", -1), "declared": F.col("_lang")}
