"""Operators 6 and 9, and the pipeline."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tarn.llm import queries, secrets, toxicity

TEXTS = [
    None,
    "",
    "password=abc12",  # five characters are too few
    "PassWord : 'abcdef' and token=\"x.y/z=+_-\" apikey:1234567 api_key = 7654321",
    "ſecret=abcdef secret=abcdef",
    "é AKIA" + "A" * 16 + " AKIA" + "B" * 15 + " xAKIA" + "C" * 40,
    "a" * 23 + " " + "b" * 24 + " " + "0123456789abcdef" * 4,
    "password=passwd=secret=token=abcdef",
    "passwd= " + "z" * 100_000,
    "token=" + "ab" * 20,
    "user=alice host https://db.example.com/x " + "Ab1" * 14,
    "user=alice " + "w " * 400 + "https://db.example.com/x",
    "https://db.example.com/x alone",
]


def base(text):
    t = text or ""
    out = [("assign", m.start(), m.end()) for m in re.finditer(r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


def test_secrets(documents):
    found = {x["key"]: [(s["kind"], s["start"], s["end"]) for s in x["spans"]] for x in secrets.scan(documents(TEXTS)).collect()}
    for i, t in enumerate(TEXTS):
        assert [s for s in found[i] if s[0] in secrets.BASE] == base(t), t
    assert {k for k, _, _ in found[10]} == {"user", "endpoint", "opaque"}
    assert found[11] == [] and found[12] == []  # too far apart; alone
    assert secrets.scan(documents([])).collect() == []


def linked_spans(text, scopes):
    """All spans by the definition: every weak part against every other part of the text."""
    found = secrets.spans(text or "")
    out = []
    for kind, a, b in found:
        met = []
        for other, c, d in found:
            pair = tuple(sorted((secrets.ROLES[kind], secrets.ROLES[other])))
            if pair in scopes and max(c - b, a - d, 0) <= scopes[pair]:
                met.append((c, secrets.KINDS.index(other) + 1, d, other))
        if kind in secrets.BASE:
            out.append((kind, a, b, []))
        elif met:
            out.append((kind, a, b, sorted(met)))
    return out


def test_linked_spans_against_brute_force(documents):
    r = random.Random(21)
    parts = ["user=alice", "login: bob_9", "https://db.example.com/x", "ssh://host/" + "p" * 60, "Ab1" * 14, "AKIA" + "Q" * 16, "token=abcdef9", "c0ffee" * 5, "https://h.example/?user=carol&user=dave"]
    texts = [None, "", *TEXTS[2:]] + [" ".join(r.choice([*parts, "w " * r.randint(1, 30), "é" * r.randint(1, 90)]) for _ in range(r.randint(1, 25))) for _ in range(120)]
    texts.append("https://long.example/" + "&user=erin" * 3000)  # one part that lies around very many
    for scopes in (secrets.SCOPES, {("identifier", "secret"): 0, ("endpoint", "identifier"): 37}):
        got = {x["key"]: [(s["kind"], s["start"], s["end"], [tuple(p) for p in s["linked"]]) for s in x["spans"]] for x in secrets.scan(documents(texts), scopes).collect()}
        for i, t in enumerate(texts):
            assert got[i] == linked_spans(t, scopes), (t or "")[:200]


def test_redact(documents):
    got = {x["doc_id"]: x["text"] for x in secrets.redact(documents(TEXTS)).collect()}
    assert got[0] is None and got[1] == "" and got[2] == TEXTS[2] and got[12] == TEXTS[12]
    assert got[9] == "[SECRET]" and "alice" not in got[10]


def test_redact_keeps_other_columns(documents, clash):
    for x in secrets.redact(documents(["token=abcdef", "clean", None])).collect():
        assert {k: x[k] for k in clash} == clash


def test_secret_query(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for x in queries.op6_secret_scans(spark, sf).collect():
        want = base(docs[x["doc_id"]])
        assert x["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert (x["n_assign"], x["n_access"], x["n_hex"]) == tuple(sum(k == kind for k, _, _ in want) for kind in secrets.BASE)


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    found = queries.op9_toxicity(spark, sf).toPandas()
    assert len(found) == 1000 and found["score"].between(0, 1).all() and ((found["score"] >= 0.3) == (found["predicted"] == 1)).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in zip(found["doc_id"], found["held_out"], strict=True))
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    m = found.merge(labels, on="doc_id")
    m = m[m["held_out"]]
    hit = ((m["predicted"] == 1) & (m["toxic"] == 1)).sum()
    assert hit / m["toxic"].sum() > 0.6 and hit / m["predicted"].sum() > 0.5


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, toxic int")


def test_toxicity_edges(spark, documents):
    fold = F.crc32(F.col("key").cast("string")) % 4
    texts = ["good calm day", "vile scum here"] * 40 + [None, "", "w" * 50_000, "scum"]
    labels = [(i, i % 2) for i in range(80)] + [(3, None), (None, 1), (4, 0)]
    got = {x["key"]: x["score"] for x in toxicity.score(documents(texts), labelled(spark, labels), fold != 3, fold == 3).collect()}
    assert len(got) == len(texts) and all(0 <= s <= 1 for s in got.values()) and got[1] > 0.3 > got[0] and got[83] > got[82]
    for some in ([], [(0, 0)], [(0, 0), (1, 0)]):
        assert {x["score"] for x in toxicity.score(documents(texts), labelled(spark, some), fold != 3, fold == 3).collect()} == {0.0}
    assert toxicity.score(documents([]), labelled(spark, labels), fold != 3, fold == 3).collect() == []


def plain_kneser_ney(rows, order, discount=0.75, prior=toxicity.PRIOR):
    """p(label, context, byte) from (text, label) rows by dictionaries alone."""
    counts = [Counter(), Counter()]
    for text, label in rows:
        for w in text.lower().encode().split():
            padded = b" " * (order - 1) + w + b" "
            counts[label].update(padded[i : i + order] for i in range(len(w) + 1))
    both = counts[0] + counts[1]
    levels = {order: both}
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])

    def shared(context, byte):
        k = len(context) + 1
        lower = shared(context[1:], byte) if k > 1 else 1 / 256
        after = {g: c for g, c in levels[k].items() if g[:-1] == context}
        n = sum(after.values())
        return max(after.get(context + byte, 0) - discount, 0) / n + discount * len(after) / n * lower if n else lower

    def p(label, context, byte):
        after = {g: c for g, c in both.items() if g[:-1] == context}
        low = shared(context[1:], byte)
        n = sum(after.values())
        if not n:
            return low
        w = discount * len(after) / n
        own = {g: c for g, c in counts[label].items() if g[:-1] == context}
        q = max(after.get(context + byte, 0) - discount, 0) / n / (1 - w)
        return (1 - w) * (own.get(context + byte, 0) + prior * q) / (sum(own.values()) + prior) + w * low

    return p, both


CORPUS = [(f"{a}{b}{c} word", 0) for a in "abc" for b in "abc" for c in "abc"] + [("vile scum abc", 1), ("scum bca vile", 1), ("ab ab scumword", 1), ("é word", 0)]


def test_kneser_ney_against_plain_python(spark):
    p, both = plain_kneser_ney(CORPUS, 3)
    counts = toxicity.count_grams(spark.createDataFrame(CORPUS, "text string, label int"), 3)
    got = {x["gram"].to_bytes(3, "big"): x for x in toxicity.ratios(counts, 3).collect()}
    assert set(got) == set(both)
    for g, x in got.items():
        want = [p(label, g[:-1], g[-1:]) for label in (0, 1)]
        assert (x["ordinary"], x["toxic"]) == pytest.approx(want, rel=1e-12) and x["ratio"] == pytest.approx(math.log(want[1] / want[0]), abs=1e-12)
    for context in {g[:-1] for g in both} | {b"zz"}:  # probabilities sum to one, and what training never saw tells nothing
        for label in (0, 1):
            assert sum(p(label, context, bytes([b])) for b in range(256)) == pytest.approx(1)
        assert p(0, context, b"\xff") == p(1, context, b"\xff")


def test_text_features_against_plain_python(spark, documents):
    """Both ways of scoring give the length-normalised difference of the two log-likelihoods, backed off to the end."""
    p, _ = plain_kneser_ney(CORPUS, 3)
    model = toxicity.ratios(toxicity.count_grams(spark.createDataFrame(CORPUS, "text string, label int"), 3), 3)
    texts = [None, "", " ", "scum", "Scum vile word", "unseen ÿ qqq", "abc " * 500, "w" * 200 + " scum", "scum"]
    docs = documents(texts).select(F.col("doc_id").alias("row"), F.col("doc_id").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    for way in (toxicity.features, toxicity.features_by_joins):
        got = {x["row"]: (x["mean"], x["share"]) for x in way(docs, model, 3).collect()}
        for i, t in enumerate(texts):
            words = [w[k : k + toxicity.WORD_BYTES] for w in (t or "").lower().encode().split() for k in range(0, len(w), toxicity.WORD_BYTES)]
            each = []
            for w in words:
                padded = b"  " + w + b" "
                each.append([math.log(p(1, padded[j : j + 2], padded[j + 2 : j + 3]) / p(0, padded[j : j + 2], padded[j + 2 : j + 3])) for j in range(len(w) + 1)])
            grams = sum(map(len, each))
            want = (sum(map(sum, each)) / grams if grams else 0, sum(sum(e) > toxicity.VOTE for e in each) / len(each) if each else 0)
            assert got[i] == pytest.approx(want, abs=1e-9), (way, t)


def test_scores_do_not_depend_on_the_way(spark, documents):
    fold = F.crc32(F.col("key").cast("string")) % 4
    docs, labels = documents(["good calm day", "vile scum here", "calm scum"] * 20), labelled(spark, [(i, int(i % 3 == 1)) for i in range(60)])
    one, two = ({x["key"]: x["score"] for x in toxicity.score(docs, labels, fold != 3, fold == 3, table_rows=n).collect()} for n in (10**6, 0))
    assert one == pytest.approx(two, abs=1e-9) and len(set(one.values())) > 1


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, frames[-1], sf).write.parquet(path)
        frames.append(spark.read.parquet(path))
    return frames


def test_pipeline(staged):
    assert all(f.columns == staged[0].columns for f in staged[1:-1])
    ids = [{r["doc_id"] for r in f.select("doc_id").collect()} for f in staged]
    assert all(b <= a for a, b in zip(ids, ids[1:], strict=False)) and ids[-1] == ids[-2] and len(ids[-1]) > 100
    masked = staged[4].select("text", "n_chars").collect()
    assert all(not base(r["text"]) and r["n_chars"] == len(r["text"]) for r in masked)
    from test_dedup import fingerprint

    fps = [fingerprint(r["text"]) for r in staged[3].select("text").collect()]
    assert all(bin(a ^ b).count("1") > 4 for i, a in enumerate(fps) for b in fps[:i])


def test_pipeline_of_nothing(spark, documents):
    import corpus_pipeline

    docs = documents([]).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.collect() == []


def test_pipeline_stages_keep_other_columns(spark, documents, clash):
    import corpus_pipeline

    docs = documents(["calm day one", "calm day two and more", None])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns
        for x in out.collect():
            assert {k: x[k] for k in clash} == clash


def test_pipeline_leaves_the_last_table_only(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    path = out.inputFiles()[0].removeprefix("file:").rsplit("/", 2)[0]
    assert out.count() > 0 and len(os.listdir(path)) == 1


def test_pipeline_takes_nulls(spark, documents):
    import corpus_pipeline

    docs = documents([None, "", "a b c", "a b c", "x" * 30_000], [1, None, 3, 3, 5])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns and out.count() >= 3
