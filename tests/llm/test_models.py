"""Operators 11 to 13 against plain versions, with nulls, ties, repeats, long and empty values and clashing columns."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tarn.llm import conversation_repair as cr
from tarn.llm import hard_negatives as hn
from tarn.llm import ppm

# ---- 11: PPM


def plain_ppm(texts, keys, learn, order):
    """Tries and word counts in dictionaries, one byte after another."""
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or ""))
    split = [[w for w in lower(t).encode().replace(b"\n", b" ").replace(b"\t", b" ").split(b" ") if w] for t in texts]
    trie = defaultdict(Counter)
    counts = Counter()
    for words, yes in zip(split, learn, strict=True):
        if yes:
            counts.update([*words, "end"])
            data = b"\xff" * order + b"".join(w + b" " for w in words)[:-1] + (b" " if words else b"") + b"\xff"
            for i in range(order, len(data)):
                for k in range(order + 1):
                    trie[data[i - k : i]][data[i]] += 1
    n, v = sum(counts.values()), len(counts)
    out = []
    for words, key in zip(split, keys, strict=True):
        data = b"\xff" * order + b"".join(w + b" " for w in words) + b"\xff"
        total = 0.0
        for i in range(order, len(data)):
            gone = set()
            for k in range(order, -1, -1):
                left = {s: c for s, c in trie.get(data[i - k : i], {}).items() if s not in gone}
                if not left:
                    continue
                size = sum(left.values())
                if data[i] in left:
                    total += math.log10((2 * left[data[i]] - 1) / (2 * size))
                    break
                total += math.log10(len(left) / (2 * size))
                gone |= set(left)
            else:
                total += math.log10(1 / (256 - len(gone)))
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in [*words, "end"])
        out.append((key, len(words) + 1, sum(counts[w] > 0 for w in [*words, "end"]), n, base, total))
    return out


def texts_of(rng, n):
    made = []
    for _ in range(n):
        words = ["".join(rng.choice("abcdeéA") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(0, 30))]
        made.append(rng.choice([" ", "\n", " \t "]).join(words))
    return [*made, None, "", "   ", "same text", "same text", "x" * 5000, "Ünï Zz " * 300]


@pytest.mark.parametrize("order", [2, 5])
def test_ppm_equals_tries_in_dictionaries(spark, documents, monkeypatch, order):
    monkeypatch.setattr(ppm, "PIECE", 512)  # texts that span pieces
    monkeypatch.setattr(ppm, "BLOCK", 4000)  # and several blocks a task
    texts = texts_of(random.Random(order), 60)
    docs = documents(texts)
    fold = F.crc32(F.col("key").cast("string")) % 7
    learn = [zlib.crc32(str(i).encode()) % 7 != 2 for i in range(len(texts))]
    found = {r["key"]: r for r in ppm.score(docs, fold != 2, order=order).collect()}
    for key, tokens, known, n, base, total in plain_ppm(texts, range(len(texts)), learn, order):
        r = found[key]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (tokens, known, n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] == pytest.approx(total, rel=1e-6)


def test_ppm_edges(spark, documents):
    docs = documents(["one two", "one two", None], [None, 5, 5])
    assert ppm.score(docs.where("false"), F.lit(True)).collect() == []
    found = ppm.score(docs, F.lit(False)).collect()
    assert sorted((r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in found) == [(1, 0, 0, 0.0), (3, 0, 0, 0.0), (3, 0, 0, 0.0)]
    assert sorted(round(r["score"] / math.log10(256), 6) for r in found) == [-9.0, -9.0, -1.0]
    learned = {(r["key"], r["n_tokens"]): r for r in ppm.score(docs, F.col("key") == 5).collect()}
    assert learned[5, 3]["train_tokens"] == 4 and learned[None, 3]["score"] == learned[5, 3]["score"]


def test_adaptive_scores_learn_as_they_read(spark, documents):
    texts = ["ab ab ab ab ab ab ab ab", "qz", None, "ab " * 2000]
    found = {r["key"]: r["score"] for r in ppm.adaptive(documents(texts), order=3).collect()}
    for i, t in enumerate(texts):
        assert found[i] == pytest.approx(ppm.code_length(ppm.symbols(ppm.words_of(t or "")), 3))
    assert found[2] == pytest.approx(-math.log10(256))
    assert found[3] / 6000 > found[0] / 24 and found[0] > -len(texts[0]) * math.log10(256)


def test_ppm_beats_the_base_on_held_out_texts(spark, sf):
    from tarn.llm.queries import op11_ppm

    sums = op11_ppm(spark, sf.replace("0.001", "0.1")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert sums[0] > 0.97 * sums[1]


# ---- 12: hard negatives


def plain_negatives(rows, anchors, positives=5, negatives=3, low=50, high=95):
    whole = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    kept = [(k, [math.floor(256 * x) for x in v], lab) for k, v, lab in rows if k is not None and lab is not None and whole(v)]
    out = []
    for i, (k, v, lab) in enumerate(kept):
        if k % anchors:
            continue
        score = [(-sum(x * y for x, y in zip(v, w, strict=True)), key, label, j) for j, (key, w, label) in enumerate(kept) if len(w) == len(v)]
        for p, pk, _, _ in sorted(s for s in score if s[2] == lab and s[3] != i)[:positives]:
            fit = sorted(s for s in score if s[2] != lab and low * -p <= 100 * -s[0] <= high * -p)[:negatives]
            out += [(k, pk, rank, nk, -p, -n) for rank, (n, nk, _, _) in enumerate(fit, 1)]
    return sorted(out)


COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def mined(frame, **given):
    return sorted(tuple(r[c] for c in COLUMNS) for r in hn.mine(frame, F.col("key") % 5 == 0, **given).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_negatives_equal_brute_force(spark, monkeypatch, seed):
    for name, value in (("LEAF", 16), ("BLOCK", 24), ("GROUP", 4), ("UNIT", 16), ("FIRST", 24)):
        monkeypatch.setattr(hn, name, value)
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 0.4) for _ in range(6)] for _ in range(8)]
    rows = []
    for i in range(300):
        m = rng.choice(middles)
        rows.append((i, [x + rng.gauss(0, 0.1) for x in m], rng.randint(0, 3)))
    hot = [0.25, 0.5, -0.25, 0.75, 0.0, 0.125]
    rows += [(1000 + i, hot, i % 3) for i in range(90)]  # equal vectors: ties by key
    rows += [(2000, None, 1), (2005, hot, None), (None, hot, 1), (2010, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (2015, [float("nan")] * 6, 1), (2020, [float("inf")] * 6, 1)]
    rows += [(2025, [0.0] * 6, 1), (2030, [0.5, 0.5], 1), (2031, [0.5, 0.25], 2), (2032, [0.5, 0.5], 1), (2035, [], 1), (2036, [], 1), (2037, [], 2), (2040, [3e6] * 6, 1), (2041, [3e6] * 6, 1), (2042, [2e6] * 6, 2)]
    rows += [rows[5], rows[5]]  # repeated anchors
    frame = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "vec_id long, embedding array<double>, label int, row int, leaf int, key string").repartition(5)
    expected = plain_negatives(rows, 5)
    assert expected and mined(frame) == expected


def test_negatives_of_an_empty_table_and_other_labels(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert mined(frame) == []
    rows = [(i, [1.0 if i % 2 else 0.6, 0.1 * i], "ab"[i % 2]) for i in range(12)]
    coded = [(k, v, {"a": 0, "b": 1}[lab]) for k, v, lab in rows]
    assert mined(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string"), positives=2, negatives=1) == plain_negatives(coded, 5, 2, 1)


def test_intervals_hold_all_products():
    import numpy as np

    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(200, 5)), rng.normal(size=(500, 5))
    trees = []
    for m in (x, y):
        nodes, leaves = hn.split(m, 10)
        centre = np.array([m[at].mean(axis=0) for at in leaves])
        radius = np.array([np.sqrt(((m[at] - c) ** 2).sum(axis=1).max()) for at, c in zip(leaves, centre, strict=True)])
        trees.append((hn.balls(nodes, centre, radius, np.array([len(at) for at in leaves])), leaves))
        assert (np.sort(np.concatenate(leaves)) == np.arange(len(m))).all()
    (a, mine), (b, theirs) = trees
    wanted = np.full(len(a.left), 4.0)
    pairs = set(zip(*(v.tolist() for v in hn.dual(a, b, wanted, np.full(len(a.left), np.inf))), strict=True))
    hit = {(i, j) for i, p in enumerate(mine) for j, q in enumerate(theirs) if (x[p] @ y[q].T >= 4.0).any()}
    assert hit <= pairs and len(pairs) < len(mine) * len(theirs)


# ---- 13: conversation repair


def plain_cost(turns):
    """The least (cost, audit) by trying all edits with up to two insertions in each gap."""
    seen = set()
    options = []
    for role, text in turns:
        body = text.strip(" \t\n\x0b\x0c\r")
        gone = not body or (role, text) in seen
        extra = 0 if gone or body[-1] in ".!?" else 3
        seen.add((role, text))
        found = [(4, "D", "")]
        if not gone:
            found += [(extra, "K", role[:1] or "-"), (3 + extra, "R", "u"), (3 + extra, "R", "a")]
        options.append(found)
    gaps = [(0, "", ""), (3, "I", "u"), (3, "I", "a"), (6, "II", "ua"), (6, "II", "au")]
    best = None
    parts = [gaps]
    for o in options:
        parts += [o, gaps]
    for choice in itertools.product(*parts):
        shape = "".join(c[2] for c in choice)
        rest = shape[1:] if shape.startswith("s") else shape
        if rest == "ua" * (len(rest) // 2) and (rest or not shape):
            made = (sum(c[0] for c in choice), "".join(c[1] for c in choice))
            best = made if best is None else min(best, made)
    return best


def test_matrices_equal_all_edits():
    rng = random.Random(5)
    for _ in range(60):
        turns = [(rng.choice(["user", "assistant", "system", "tool", " "]), rng.choice(["a.", "b!", "c", "", "d?"])) for _ in range(rng.randint(0, 3))]
        seen, kinds = set(), ""
        for role, text in turns:
            gone = not text or (role, text) in seen
            seen.add((role, text))
            k = role[0] if role[0] in "sua" else "x"
            kinds += "d" if gone else k if text[-1] in ".!?" else k.upper()
        assert cr.solution(cr.matrix(kinds)) == plain_cost(turns)


def test_product_is_associative():
    rng = random.Random(8)
    for _ in range(200):
        kinds = "".join(rng.choice("dsuaxSUAX") for _ in range(rng.randint(3, 24)))
        i, j = sorted(rng.sample(range(1, len(kinds)), 2))
        a, b, c = cr.matrix(kinds[:i]), cr.matrix(kinds[i:j]), cr.matrix(kinds[j:])
        assert cr.product(cr.product(a, b), c) == cr.product(a, cr.product(b, c)) == cr.matrix(kinds)


def sequential(rows):
    """Per conversation (counts, cost, audit, turns) with one state vector, turn after turn."""
    groups = defaultdict(list)
    for c, turn, role, text in rows:
        groups[c].append((turn is not None, turn or 0, role if role is not None else " ", hashlib.md5((text if text is not None else " ").encode()).hexdigest(), text if text is not None else " "))
    out = {}
    for c, found in groups.items():
        found.sort()
        states = {0: (0, "")}
        seen, counts = set(), [0, 0, 0]
        for _, _, role, _, text in found:
            body = text.rstrip(" \t\n\x0b\x0c\r")
            fault = 0 if not body else 1 if (role, text) in seen else 2 if body[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            for _ in range(3):
                for i, j in ((0, 2), (1, 2), (3, 2), (2, 3)):
                    if i in states:
                        states[j] = min(states.get(j, (1 << 60, "")), (states[i][0] + 3, states[i][1] + "I"))
            after = defaultdict(list)
            for i, (cost, audit) in states.items():
                after[i].append((cost + 4, audit + "D"))
                if fault not in (0, 1):
                    more = 3 if fault == 2 else 0
                    for (at, initial), j in cr.STEP.items():
                        if at == i and initial == role[:1]:
                            after[j].append((cost + more, audit + "K"))
                        elif at == i and initial != "s":
                            after[j].append((cost + more + 3, audit + "R"))
            states = {j: min(v) for j, v in after.items()}
        if 2 in states:
            states[3] = min(states.get(3, (1 << 60, "")), (states[2][0] + 3, states[2][1] + "I"))
        cost, audit = min(v for j, v in states.items() if j in (0, 3))
        lines, at, last = [], 0, ""
        for e in audit:
            role, text = ("", "") if e == "I" else (found[at][2], found[at][4])
            at += e != "I"
            if e == "D":
                continue
            role = role if e == "K" else "assistant" if last == "u" else "user"
            last = role[:1]
            lines.append(f"{role}:{text}")
        initials = [r[2][:1] for r in found]
        turns = [r[1] for r in found if r[0]]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:], strict=False))
        out[c] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def repaired(frame):
    report, turns = cr.repair(frame)
    sums = {r["conv"]: r["sha256"] for r in cr.digests(turns).collect()}
    return {r["conv"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], sums[r["conv"]]) for r in report.collect()}


@pytest.mark.parametrize("bits", [1, 3, 10])
def test_repair_equals_a_sequential_pass(spark, monkeypatch, bits):
    monkeypatch.setattr(cr, "BLOCK_BITS", bits)  # conversations over many blocks, and rounds of the tree
    monkeypatch.setattr(cr, "FAN_BITS", 2)
    rng = random.Random(bits)
    say = lambda: rng.choice(["Yes.", "No!", "What?", "cut", "", "  ", None, "Ünï.", "x\ny.", "a" * 3000 + "."])
    rows = [(c, rng.choice([None, *range(12)]), rng.choice(["user", "assistant", "system", "tool", "", None]), say()) for c in [None, *range(12)] for _ in range(rng.randint(1, 9))]
    rows += [(99, k, ("user", "assistant")[k % 2], f"turn {k // 7}." if k % 5 else say()) for k in range(400)]  # one long conversation
    rows += [rows[3]] * 3
    frame = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "conv_id long, turn long, role string, text string, seq int, conv string, block int").repartition(7)
    assert repaired(frame) == sequential(rows)


def test_repair_of_nothing_and_of_far_turns(spark):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repaired(frame) == {}
    ends = spark.createDataFrame([(1, -(1 << 63), "user", "a."), (1, (1 << 63) - 1, "assistant", "b.")], frame.schema)
    assert repaired(ends)[1][0] == 0  # more gaps than a long holds


def test_damage_follows_its_rule(spark):
    rows = [(c, t, "assistant", "So. It! Is?") for c in (None, *range(8)) for t in (None, *range(12))]
    expected = Counter()
    for c, t, role, text in rows:
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        made = (c, t, "user" if fault == 4 else role, "" if fault == 1 else "So It Is" if fault == 2 else text)
        expected[made] += 0 if fault == 0 else 2 if fault == 3 else 1
    found = Counter(map(tuple, cr.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()))
    assert found == +expected


# ---- the registered queries


@pytest.mark.parametrize("name", ["op12_hard_negatives", "op13_conversation_repair"])
def test_query_equals_its_sql(spark, sf, name):
    from compare import connect, rows

    from tarn.llm.queries import ORACLES, QUERIES

    assert rows(QUERIES[name](spark, sf).toPandas()) == rows(connect(sf).execute(ORACLES[name]).fetchdf())
