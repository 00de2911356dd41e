"""Language identification and toxicity: held-out accuracy and edge cases."""

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from foliant.llm import language, toxicity

SYLLABLES = {"en": "the ing and tion er ou th st".split(), "fr": "eau ré ç oi le que è ment".split(), "de": "sch ein ung ß ver ich keit ö".split()}


def texts(seed, n):
    r = random.Random(seed)
    out = []
    for i in range(n):
        lang = r.choice(list(SYLLABLES))
        out.append((i, " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 3))) for _ in range(r.choice([3, 20, 80]))), lang))
    return out


def test_text_language(spark):
    rows = texts(1, 300)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(df.where("doc_id % 2 = 0"))
    out = {r.doc_id: r for r in language.identify(df.where("doc_id % 2 = 1").drop("lang"), model).collect()}
    assert sum(out[i].language == lang for i, _, lang in rows if i % 2) >= 0.97 * len(out)


def test_evidence_and_nulls(spark):
    df = spark.createDataFrame(texts(2, 200), "doc_id long, text string, lang string")
    model = language.train(df)
    rows = [(1000 + i, None, f"h{i % 2}.fr.example.fr" if i % 3 else None, "fr-FR" if i % 2 else None) for i in range(6)]
    rows += [(i, t, "www.site.fr" if lang == "fr" else "www.site.de", lang) for i, t, lang in texts(3, 60)]
    pages = spark.createDataFrame(rows, "doc_id long, text string, host string, declared string").withColumn("language", F.lit("clash"))
    found = language.identify(pages, model, host=F.col("host"), domain=F.substring_index("host", ".", -2), suffix=F.substring_index("host", ".", -1), declared=F.col("declared"))
    out = {r.doc_id: r for r in found.collect()}
    assert len(out) == 66
    assert all(not out[1000 + i].accepted and out[1000 + i].text_language is None for i in range(6))
    assert out[1001].language == "fr"
    assert all(out[i].language == lang and out[i].accepted for i, t, lang in texts(3, 60) if len(t) > 60)


@pytest.mark.parametrize("share", [1 / 1024, 0.2, 2])
def test_fusion_beside_plain_python(spark, monkeypatch, share):
    """With all hosts hot, one that a third of all rows have, and none; joined by key."""
    monkeypatch.setattr(language, "HOT_SHARE", share)
    monkeypatch.setitem(language.__dict__, "SPREAD", 3)
    model = language.train(spark.createDataFrame(texts(2, 200), "doc_id long, text string, lang string"))
    r = random.Random(8)
    hosts = ["big.site.de", "big.site.de", "a.site.de", "b.other.fr", "c.other.fr", None]
    rows = [(i, t if i % 9 else r.choice(["", None, "zz"]), r.choice(hosts), r.choice(["fr-FR", "xx", "", None, lang])) for i, t, lang in texts(4, 90)]
    rows += rows[:3] + [(None, None, None, None), (900, "", "never.seen.fr", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, host string, declared string")
    host = F.col("host")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = language.identify(df, model, host=host, domain=F.substring_index(host, ".", -2), suffix=F.substring_index(host, ".", -1), declared=F.col("declared")).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")

    names, own = model.languages, []
    for x in language._likelihoods(df, "text", model).collect():
        tag = (x.declared or "").split("-")[0]
        keys = {"host": x.host, "domain": x.host and x.host.split(".", 1)[1], "suffix": x.host and x.host.split(".")[-1], "declared": (tag if tag in names else "other") if tag else None}
        own.append((x, keys, x._ll.index(max(x._ll))))
    of, by = [0] * len(names), defaultdict(lambda: [0] * len(names))
    for x, keys, best in own:
        if x._n:
            of[best] += 1
            for k, v in keys.items():
                if v is not None:
                    by[k, v][best] += 1
    want = Counter()
    for x, keys, best in own:
        prior = [(n + 1) / (sum(of) + len(of)) for n in of]
        for k in ("domain", "host"):
            n = by.get((k, keys[k]))
            prior = [(c + language.STRENGTH * p) / (sum(n) + language.STRENGTH) for c, p in zip(n, prior)] if n else prior
        log = [v / language.TEMPER + math.log(p) for v, p in zip(x._ll, prior)]
        for k in ("declared", "suffix"):
            n = by.get((k, keys[k]))
            if n:
                even = language.STRENGTH * sum(n) / sum(of)
                log = [v + math.log((c + even) / (m + language.STRENGTH)) for v, c, m in zip(log, n, of)]
        confidence = 1 / sum(math.exp(v - max(log)) for v in log)
        name = names[log.index(max(log))]
        want[x.doc_id, name, round(confidence, 9), names[best] if x._n else None, bool(x._n) and confidence >= language.SURE and name != language.UNKNOWN] += 1
    assert Counter((x.doc_id, x.language, round(x.confidence, 9), x.text_language, x.accepted) for x in found) == want


def test_too_many_languages(spark, monkeypatch):
    monkeypatch.setattr(language, "MOST_LANGUAGES", 2)
    with pytest.raises(ValueError, match="more than 2 languages"):
        language.train(spark.createDataFrame(texts(2, 50), "doc_id long, text string, lang string"))


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = language.train(empty)
    assert model.languages == ["und"]
    assert language.identify(empty, model).count() == 0
    assert language.identify(spark.createDataFrame([(1, None)], "doc_id long, text string"), model).first().accepted is False


def toxic_rows(seed, n):
    r = random.Random(seed)
    common = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        bad = r.random() < 0.25
        t = [r.choice(common) for _ in range(r.choice([20, 60, 200]))]
        if bad:
            for k in range(max(2, len(t) // 20)):
                t.insert(r.randrange(len(t)), r.choice(["scoundrel", "vermin", f"nastyword{r.randrange(10**6)}"]))
        rows.append((i, " ".join(t), int(bad)))
    return rows


def test_held_out_toxicity(spark):
    rows = toxic_rows(5, 1200)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(5000, None, None), (5001, "", None), (None, "w1 w2", None)], "doc_id long, text string, score string").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(rows[0][0], rows[0][2]), (None, 1), (7777, 1), (5000, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    out = {r.doc_id: r.score for r in toxicity.toxicity(docs, model).collect()}
    held = [(out[i] >= 0.5, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 150
    assert sum(p == y for p, y in held) >= 0.95 * len(held)
    assert out[5000] == out[5001] < 0.5
    assert all(0 <= s <= 1 for s in out.values())


def test_texts_of_toxic_words_only(spark):
    rows = toxic_rows(6, 1200)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    short = ["vermin", "Vermin scoundrel", "w1. scoundrel vermin", "vermin vermin vermin", "w1", "w1 w2 w3", ""]
    out = {r.doc_id: r.score for r in toxicity.toxicity(spark.createDataFrame(list(enumerate(short)), "doc_id long, text string"), model).collect()}
    assert all(out[i] >= 0.5 for i in range(4)), out
    assert all(out[i] < 0.5 for i in range(4, 7)), out


def test_steps_are_told_apart(spark):
    """'cala' and 'dote' agree in the leading 21 bits of their hashes, and thus shared a bucket."""
    r = random.Random(7)
    rows = [(i, " ".join(f"w{r.randrange(90)}" for _ in range(20)), int(i % 4 == 0)) for i in range(1200)]
    rows = [(i, f"{t} {'cala cala' if y else 'dote'} x{i}", y) for i, t, y in rows]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    counted = toxicity._counted(spark.createDataFrame([(t, y) for _, t, y in rows], "text string, toxic int"))
    assert counted.where("level = 0 AND n0 + n1 = 1 AND followed <> 1").count() == 0
    assert sorted((r.n0, r.n1) for r in counted.where("level = 0 AND (n1 = 300 OR n0 = 900)").collect()) == [(0, 300), (900, 0)]
    model = toxicity.train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    short = spark.createDataFrame([(0, "cala"), (1, "dote"), (1, "dote"), (None, "cala w1"), (None, "cala w1")], "at long, text string")
    out = {(r.at, r.text): r.score for r in toxicity.toxicity(short, model).collect()}
    assert toxicity.toxicity(short, model).count() == 5
    assert out[0, "cala"] >= 0.5 and out[None, "cala w1"] >= 0.5 and out[1, "dote"] < 0.5


def test_labels_of_one_kind(spark):
    docs = spark.createDataFrame([(i, "a b c") for i in range(20)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.train(docs, none) == 0.0
    assert toxicity.toxicity(docs, 0.0).first().score == 0.0
    assert toxicity.train(docs, spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, toxic int")) == 1.0


def test_languages_of_held_out_documents(spark):
    """The given documents, a fifth of which the model doesn't see."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = language.train(docs.where(~held))
    out = language.identify(docs.where(held).select("doc_id", "lang", "source", "text"), model, host=F.col("source")).collect()
    assert len(out) > 150
    assert sum(r.language == r.lang for r in out) >= 0.98 * len(out)
    assert sum(r.accepted for r in out) >= 0.98 * len(out)


def test_unknown_languages_are_rejected_and_rare_ones_known(spark):
    rows = texts(8, 400) + [(900 + i, "jumalauta hyvää päivää kiitos paljon talo järvi " * (3 + i % 3), "fi") for i in range(6)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["de", "en", "fi", "fr", "und"]
    asked = [(1, "hyvää päivää talo järvi kiitos"), (2, "xqj zzkw qqxv wzzq jjxq kkvz qxqx zvzv wqwq xjxj " * 4), (3, "the tion and ing " * 50_000), (3, "the tion and ing " * 50_000)]
    out = language.identify(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()
    found = {r.doc_id: (r.language, r.accepted) for r in out}
    assert len(out) == 4
    assert found == {1: ("fi", True), 2: ("und", False), 3: ("en", True)}


def test_toxicity_without_rows_and_of_long_texts(spark):
    rows = toxic_rows(9, 900)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    assert toxicity.toxicity(docs.limit(0), model).count() == 0
    long = [(1, "w1 w2 " * 400_000), (2, "vermin scoundrel w3 " * 200_000), (2, "vermin scoundrel w3 " * 200_000)]
    out = [(r.doc_id, r.score >= 0.5) for r in toxicity.toxicity(spark.createDataFrame(long, "doc_id long, text string"), model).collect()]
    assert sorted(out) == [(1, False), (2, True), (2, True)]
    assert toxicity.train(docs.limit(0), spark.createDataFrame([], "doc_id long, toxic int")) == 0.0


def step_of(word, k):
    """Level, beginning, and whether the word goes on behind it."""
    n = (*toxicity.STEPS, 10**9)[k]
    return k, word[:n], len(word) > n


def plain_kneser_ney(rows):
    """(ended, failed) of every beginning of a word, from texts and labels, by dictionaries."""
    from math import log

    docs, before = {}, {}
    for text, y in rows:
        seen, last = set(), None
        for word in text.lower().split():
            steps = [step_of(word, 0)] + [step_of(word, k + 1) for k, n in enumerate(toxicity.STEPS) if len(word) > n]
            first = steps[0]
            before.setdefault(first, set()).add(last)
            last = word
            seen |= {(s, steps[i - 1] if i else None) for i, s in enumerate(steps)}
        for step in seen:
            docs.setdefault(step, [0, 0])[y] += 1
    tokens = [max(1, sum(n[c] for (_, start), n in docs.items() if start is None)) for c in (0, 1)]
    less = lambda n, c: max(n[c] - toxicity.DISCOUNT * tokens[c] / min(tokens), 0)
    groups = {}
    for (step, start), n in docs.items():
        groups.setdefault(start, []).append((step, n))
    followed = sum(len(before[s]) for s, _ in groups[None])
    facts, ratio = {}, {}
    for start, members in groups.items():
        mass, t = sum(sum(n) for _, n in members), [sum(less(n, c) for _, n in members) for c in (0, 1)]
        back = min(max(0.75 * len(members) / max(mass, 1), 0.02), 0.98)
        facts[start] = sum((log(back) if t[c] > 0 else 0) * (1 if c else -1) for c in (0, 1))
        for step, n in members:
            shared = (len(before[step]) + 0.5) / (followed + 0.5 * len(members)) if start is None else (sum(n) + 0.5) / (mass + 0.5 * len(members))
            p = [(1 - back) * min(less(n, c) / max(t[c], 1e-6), 1) + back * shared if t[c] > 0 else shared for c in (0, 1)]
            ratio[step] = (log(p[1] / p[0]), start)
    out = {}
    for step in sorted(ratio):
        r, start = ratio[step]
        ended = r + (out[start][0] if start else 0)
        out[step] = (ended, ended + facts.get(step, 0))
    return out


def test_counts_beside_plain_dictionaries(spark):
    import numpy as np

    r = random.Random(12)
    stems = ["tox", "toxicword", "toxiclonger", "plain", "plainness", "vermi", "verminous", "a", "calm", "calmness"]
    rows = []
    for i in range(400):
        y = int(r.random() < 0.3)
        rows.append((" ".join(r.choice(stems[:3] + stems[5:7] if y and r.random() < 0.4 else stems[3:5] + stems[7:]) + r.choice(["", "", "s", "ly"]) for _ in range(r.randint(1, 12))), y))
    nodes = toxicity._nodes(toxicity._counted(spark.createDataFrame(rows, "text string, toxic int").repartition(3))).collect()
    got = {(n.level, n.at): (n.ended, n.failed) for n in nodes}
    want = plain_kneser_ney(rows)
    words = sorted({w for t, _ in rows for w in t.split()})
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    path = toxicity._path(raw, np.array([0, len(raw)]))
    met = 0
    for k, (at, _, takes) in enumerate(path.steps):
        for i in np.flatnonzero(takes):
            step = step_of(words[i], k)
            key = (k, int(at[i].astype(np.int64)))
            if key in got:
                met += 1
                assert np.allclose(got[key], want[step]), step
            else:
                assert max(want[step]) <= toxicity.LEVELS[0] + 1e-9, step
    assert met > 5


def class_kneser_ney(rows):
    """(ended, failed) of every beginning of a word by Kneser-Ney models of the classes, from texts and labels, by dictionaries."""
    from math import log

    docs, before = {}, {}
    for text, y in rows:
        seen, last = set(), None
        for word in text.lower().split():
            steps = [step_of(word, k) for k, n in enumerate((0, *toxicity.STEPS)) if len(word) > n]
            before.setdefault(steps[0], set()).add(last)
            last = word
            seen |= {(s, steps[i - 1] if i else None) for i, s in enumerate(steps)}
        for step in seen:
            docs.setdefault(step, [0, 0])[y] += 1
    tokens = [sum(n[c] for (_, start), n in docs.items() if start is None) for c in (0, 1)]
    takes = [toxicity.DISCOUNT * t / min(tokens) for t in tokens]
    further = lambda step, start: (step[0], step[1][len(start[1]) :], step[2])
    follows, of_level = {}, {}
    for step, start in docs:
        if start:
            follows.setdefault(further(step, start), set()).add(start)
            of_level[step[0]] = of_level.get(step[0], 0) + 1
    mass, left = {}, {}
    for (_, start), n in docs.items():
        for c in (0, 1):
            mass[start, c] = mass.get((start, c), 0) + n[c]
            left[start, c] = left.get((start, c), 0) + max(n[c] - takes[c], 0)
    back = {k: 1 - left[k] / m if m else 1.0 for k, m in mass.items()}
    ratio = {}
    for (step, start), n in docs.items():
        shared = len(follows[further(step, start)]) / of_level[step[0]] if start else len(before[step]) / sum(map(len, before.values()))
        p = [max(n[c] - takes[c], 0) / max(mass[start, c], 1) + back[start, c] * shared for c in (0, 1)]
        ratio[step] = (log(p[1] / p[0]), start)
    out = {}
    for step in sorted(ratio):
        r, start = ratio[step]
        ended = r + (out[start][0] if start else 0)
        out[step] = (ended, ended + (log(back[step, 1] / back[step, 0]) if (step, 0) in back else 0))
    return out


def test_models_are_kneser_ney(spark):
    import numpy as np

    r = random.Random(13)
    stems = ["tox", "toxicword", "toxiclonger", "plain", "plainness", "vermi", "verminous", "verminously", "a", "calm", "calmness"]
    rows = []
    for _ in range(500):
        y = int(r.random() < 0.3)
        rows.append((" ".join(r.choice(stems[:3] + stems[5:8] if y and r.random() < 0.4 else stems[3:5] + stems[8:]) + r.choice(["", "", "s", "ly"]) for _ in range(r.randint(1, 12))), y))
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string").repartition(3)
    model = toxicity.train(docs, spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int"))
    got = {(n.level, n.at): (n.ended, n.failed) for n in model.nodes.collect()}
    want = class_kneser_ney([x for i, x in enumerate(rows) if zlib.crc32(str(i).encode()) % toxicity.FOLDS not in (toxicity.HELD_OUT, toxicity.CALIBRATE)])
    words = sorted({w for t, _ in rows for w in t.split()})
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    met = 0
    for k, (at, _, takes) in enumerate(toxicity._path(raw, np.array([0, len(raw)])).steps):
        for i in np.flatnonzero(takes):
            step, key = step_of(words[i], k), (k, int(at[i].astype(np.int64)))
            if key in got:
                met += k > 0
                assert np.allclose(got[key], want[step]), step
            elif step in want:
                assert max(want[step]) <= toxicity.LEVELS[0] + 1e-9, step
    assert met > 5


def test_every_word_counts(spark, monkeypatch):
    """The mean log-likelihood ratio of whole texts beside dictionaries, wherever the ratios are found."""
    from math import isclose, log

    r = random.Random(14)
    stems = ["tox", "toxicword", "toxiclonger", "plain", "plainness", "vermi", "verminous", "verminously", "a", "calm", "calmness"]
    rows = [(" ".join(r.choice(stems[:3] + stems[5:8] if y and r.random() < 0.4 else stems[3:5] + stems[8:]) + r.choice(["", "", "s"]) for _ in range(r.randint(1, 12))), y) for y in (int(r.random() < 0.3) for _ in range(400))]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int")
    learned = [x for i, x in enumerate(rows) if zlib.crc32(str(i).encode()) % toxicity.FOLDS not in (toxicity.HELD_OUT, toxicity.CALIBRATE)]
    want, first = class_kneser_ney(learned), {}
    for text, y in learned:
        for step in {step_of(word, 0) for word in text.split()}:
            first.setdefault(step, [0, 0])[y] += 1
    tokens = [sum(n[c] for n in first.values()) for c in (0, 1)]
    root = [1 - sum(max(n[c] - tokens[c] / min(tokens), 0) for n in first.values()) / tokens[c] for c in (0, 1)]

    def ratio(word):
        known = [s for k, n in enumerate((0, *toxicity.STEPS)) if len(word) > n and (s := step_of(word, k)) in want]
        return want[known[-1]][known[-1][2]] if known else log(root[1] / root[0])

    texts = ["calm plain tox", "tox", "calm calm calm plain tox", "toxicwordy unheard toxi plainnessless", "unheard", "a a a", ""]
    asked = spark.createDataFrame(list(enumerate([*texts, texts[0]])), "doc_id long, text string")
    for common in (0, 4, 1 << 18):
        monkeypatch.setattr(toxicity, "COMMON", common)
        model = toxicity.train(docs, labels)
        assert len(model.common.value.at) <= common
        found = {x.doc_id: x.mean for x in toxicity._margins(asked, "text", model).collect()}
        for i, text in enumerate([*texts, texts[0]]):
            each = [ratio(word) for word in text.split()]
            assert isclose(found[i], sum(each) / max(len(each), 1), abs_tol=1e-9), (common, text)
    assert found[2] < found[0] < found[1]
