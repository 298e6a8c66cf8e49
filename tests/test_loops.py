"""Closed forms against plain loops, on many random cases at once."""

import random

import pytest
from pyspark.sql import functions as F

from tarn.operators import chunking, lookup, memory, storage, vector


def test_near_tie_is_the_leader_rule(spark):
    r = random.Random(1)
    for case in range(4):
        sims = [round(0.9 - r.random() * 0.06, 4) for _ in range(30)]
        pref = [r.random() < 0.5 for _ in sims]
        order = sorted(range(30), key=lambda i: (-sims[i], i))
        buckets, lead = [], None
        for i in order:
            if lead is None or lead - sims[i] > 0.01:
                buckets.append([])
                lead = sims[i]
            buckets[-1].append(i)
        want = [i for b in buckets for i in sorted(b, key=lambda i: not pref[i])][:8]
        df = spark.createDataFrame([(i, s, p) for i, (s, p) in enumerate(zip(sims, pref, strict=True))], "id int, similarity double, preferred boolean")
        got = [x["id"] for x in vector.near_tie(df, 8, "preferred", "id").orderBy("rank").collect()]
        assert got == want, case


def test_diversify_is_the_two_pass_loop(spark):
    r = random.Random(2)
    rows = [(i, r.choice("abc"), r.randint(0, 5) / 10) for i in range(25)]
    ranked = sorted(rows, key=lambda x: (-x[2], x[0]))
    count, first, rest = {}, [], []
    for x in ranked:
        count[x[1]] = count.get(x[1], 0) + 1
        (first if count[x[1]] <= 2 else rest).append(x[0])
    df = spark.createDataFrame(rows, "id int, file string, similarity double")
    assert [x["id"] for x in vector.diversify(df, 9, "file", "id").orderBy("rank").collect()] == (first + rest)[:9]


def naive_turns(roles):
    out, n, before = [], -1, ""
    for role in roles:
        if role == "user" or (role == "assistant" and before not in ("user", "assistant")):
            n += 1
        if role in ("user", "assistant"):
            out.append(n)
        before = role
    return out


def test_turns(spark):
    r = random.Random(3)
    cases = [[r.choice(["user", "assistant", "system"]) for _ in range(r.randint(0, 9))] for _ in range(60)] + [["assistant"], ["user", "user"], ["user", "system", "assistant"], ["assistant", "user"]]
    df = spark.createDataFrame([(c, i, role) for c, roles in enumerate(cases) for i, role in enumerate(roles)], "c int, i int, role string")
    got = {}
    for x in memory.turns(df, "c", "i", "role").orderBy("c", "i").collect():
        got.setdefault(x["c"], []).append(x["turn_no"])
    for c, roles in enumerate(cases):
        assert got.get(c, []) == naive_turns(roles), roles


def naive_merge(ranges):
    kept = []
    for a, b in ranges:
        for k in kept:
            if k[0] <= b and a <= k[1]:
                k[0], k[1] = min(k[0], a), max(k[1], b)
                break
        else:
            kept.append([a, b])
    return kept


def test_merge_ranges(spark):
    r = random.Random(4)
    cases = [[(a := r.randint(1, 30), a + r.randint(0, 8)) for _ in range(r.randint(1, 8))] for _ in range(80)]
    df = spark.createDataFrame([(f, k, a, b) for f, c in enumerate(cases) for k, (a, b) in enumerate(c)], "file int, rank int, a int, b int")
    got = {}
    for x in memory.merge_ranges(df, "file", "rank", "a", "b").orderBy("file", "range_no").collect():
        got.setdefault(x["file"], []).append([x["range_start"], x["range_end"]])
    assert [got[f] for f in range(len(cases))] == [naive_merge(c) for c in cases]


def test_merge_ranges_over_many_bins_and_without_bounds(spark):
    """Ranges longer than a bin, chains over bins, ties in rank, a null file, null and turned bounds."""
    r = random.Random(5)
    cases = [[(a := r.randint(-20_000, 60_000), a + r.choice([0, 5, 500, 9_000])) for _ in range(r.randint(1, 30))] for _ in range(40)]
    rows = [(f or None, k, a, b) for f, c in enumerate(cases) for k, (a, b) in enumerate(c)]
    rows += [(99, 0, 3, None), (99, 1, None, 4), (99, 2, 9, 5), (99, 3, 1, 10), (99, 3, 8, 20)]
    got = {}
    for x in memory.merge_ranges(spark.createDataFrame(rows, "file int, rank int, a int, b int"), "file", "rank", "a", "b").orderBy("file", "range_no").collect():
        got.setdefault(x["file"] or 0, []).append([x["range_start"], x["range_end"]])
    assert got.pop(99) == [[3, None], [None, 4], [9, 5], [1, 20]]
    assert [got[f] for f in range(len(cases))] == [naive_merge(c) for c in cases]
    assert memory.merge_ranges(spark.createDataFrame([], "file int, rank int, a int, b int"), "file", "rank", "a", "b").collect() == []


def test_equal_ranges_share_an_island(spark, sf):
    """Equal ranges, of which only one opened the island, in whatever order a sort leaves them."""
    a = F.col("l_partkey") * 7 % 1000
    items = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.expr("l_orderkey div 16").alias("file"), a.alias("a"), (a + F.col("l_suppkey") % 9 + F.col("l_linenumber") * 3).alias("b"))
    assert memory.islands(items).groupBy("file", "a", "b").agg(F.count_distinct("island").alias("n")).where("n > 1").count() == 0


@pytest.mark.parametrize("most", [0, 60, 1 << 16])
def test_files_and_islands_agree(spark, sf, monkeypatch, most):
    """All files by islands, the larger ones, and none: then there is one shuffle and no window."""
    monkeypatch.setattr(memory, "FILE_RANGES", most)
    a = F.col("l_partkey") * 7 % 1000
    items = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.expr("l_orderkey div 16").alias("file"), F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("rank"), a.alias("a"), (a + F.col("l_suppkey") % 9 + F.col("l_linenumber") * 3).alias("b"))
    found = memory.merge_ranges(items, "file", "rank", "a", "b")
    got, cases = {}, {}
    for x in found.orderBy("file", "range_no").collect():
        got.setdefault(x["file"], []).append([x["range_start"], x["range_end"]])
    for x in items.orderBy("file", "rank", "a", "b").collect():
        cases.setdefault(x["file"], []).append((x["a"], x["b"]))
    assert got == {f: naive_merge(c) for f, c in cases.items()}
    if most == 1 << 16:
        plan = found._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("RepartitionByExpression") + plan.count("Exchange") == 1 and "Window" not in plan


def test_a_file_with_a_million_ranges(spark):
    """Half of them in one island, half apart."""
    n = 1 << 20
    k = F.col("id")
    a = F.when(k % 2 == 0, F.pmod(k * 7919, F.lit(n)) * 4).otherwise(10 * n + k * 10)
    found = memory.merge_ranges(spark.range(n).select(F.lit("x").alias("file"), "id", a.alias("a"), (a + 8).alias("b")), "file", "id", "a", "b")
    apart = F.col("range_start") >= 10 * n
    got = found.agg(F.count(F.when(apart, 1)), F.max("range_no") + 1 - F.count("*"), F.min(F.when(~apart, F.col("range_start"))), F.max(F.when(~apart, F.col("range_end")))).first()
    assert tuple(got) == (n // 2, 0, 0, 4 * (n - 2) + 8)


def naive_lines(text, size, overlap):
    lines = text.replace("\r\n", "\n").split("\n")
    out, at = [], 0
    while True:
        part = lines[at : at + size]
        if "\n".join(part).strip():
            out.append((at + 1, at + len(part), "\n".join(part).strip()))
        if at + size >= len(lines):
            return out
        at += size - overlap


def test_line_chunks(spark):
    texts = ["", "\n", "a", *["\n".join(f"l{i}" for i in range(n)) for n in (1, 8, 9, 50, 51, 58, 59, 92, 93, 140)], "a\r\nb\r\n", "x" + "\n" * 60 + "y"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {}
    for x in chunking.line_chunks(df, "text").orderBy("id", "start_line").collect():
        got.setdefault(x["id"], []).append((x["start_line"], x["end_line"], x["content"]))
    for i, t in enumerate(texts):
        assert got.get(i, []) == naive_lines(t, 50, 8), i


def test_chunk_boundaries():
    assert chunking.cut_text("   ", 10, 2, False) == []
    assert chunking.cut_text("x" * 25, 10, 2, False) == [(0, 10), (8, 18), (16, 25)]
    text = "aaaa\n\nbbbb cccc"  # a paragraph break at 0.4 of the target ends the chunk
    assert chunking.cut_text(text, 10, 2, False)[0] == (0, 4)
    assert chunking.cut_text("aaa\n\nbbbb cccc", 10, 2, False)[0] == (0, 9)  # below 0.4 it does not
    assert chunking.cut_text("word " * 6, 12, 3, True) != chunking.cut_text("word  " * 6, 12, 3, False)
    for trimmed in (True, False):
        spans = chunking.cut_text("é" * 7 + " " + "wörd " * 40, 30, 6, trimmed)
        assert all(b - a <= 30 for a, b in spans) and all(x[0] < y[0] for x, y in zip(spans, spans[1:], strict=False))


def test_turn_chunks_keep_short_texts(spark):
    df = spark.createDataFrame([("a", ""), ("b", " short "), ("c", None)], "k string, t string")
    got = [(x["k"], x["start_char"], x["end_char"], x["content"]) for x in chunking.turn_chunks(df, "k", "t").orderBy("k").collect()]
    assert got == [("a", 0, 0, ""), ("b", 0, 7, " short "), ("c", 0, 0, "")]


def naive_budget(texts, most, top):
    out, used = [], 0
    for t in [t for t in texts if t is not None][:top]:
        if not out:
            if len(t) > most:
                t = t[:most]
                at = t.rfind("\n\n")
                t = t[:at] if at >= most * 0.5 else t
            out.append(t)
            used = len(t)
        elif used + 2 + len(t) <= most:
            out.append(t)
            used += 2 + len(t)
        else:
            break
    return out


def test_context_budget(spark):
    r = random.Random(5)
    cases = [[None if r.random() < 0.15 else r.choice(["x" * r.randint(0, 60), "ab\n\n" * r.randint(1, 20)]) for _ in range(6)] for _ in range(60)]
    cases += [["y" * 50], ["y" * 51], ["y" * 30 + "\n\n" + "z" * 40], ["y" * 48, "", "a"]]
    df = spark.createDataFrame([(c, k, t) for c, ts in enumerate(cases) for k, t in enumerate(ts)], "c int, k int, t string")
    got = {}
    for x in memory.context_budget(df, "k", "t", 50, 5, by=["c"]).orderBy("c", "k").collect():
        got.setdefault(x["c"], []).append(x["t"])
    for c, ts in enumerate(cases):
        assert got.get(c, []) == naive_budget(ts, 50, 5), ts


def test_directory_sizes(spark):
    files = [("a/b/c.txt", 3), ("a/b/d.txt", 4), ("a/e.txt", 5), ("f.txt", 6)]
    got = {x["directory"]: (x["files"], x["bytes"]) for x in storage.directory_sizes(spark.createDataFrame(files, "path string, size long")).collect()}
    assert got == {"a": (3, 12), "a/b": (2, 7)}


def test_interval_overlap_counts_each_pair_once(spark):
    c = spark.createDataFrame([(1, 0, 0, 9000), (1, 1, 8800, 12000)], "d int, chunk int, start_char int, end_char int")
    p = spark.createDataFrame([(1, 1, 0, 5000), (1, 2, 5000, 8900), (1, 3, 8900, 13000), (1, 4, 20000, 20001)], "d int, page int, span_start int, span_end int")
    got = sorted((x["chunk"], x["page"]) for x in chunking.overlap_join(c, p, ["d"]).collect())
    assert got == [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3)]
    ranges = {x["chunk"]: (x["page_start"], x["page_end"]) for x in chunking.page_ranges(c, p, ["d"], ["chunk"]).collect()}
    assert ranges == {0: (1, 3), 1: (2, 3)}


def test_hops_are_a_breadth_first_search(spark, sf):
    from tarn.operators import symbol_index, xref
    from tarn.sources.tables import code_chunks

    c = code_chunks(spark, sf)
    got = {x["chunk_id"]: x["hop"] for x in symbol_index.expand(symbol_index.build(c), [0, 1, 2]).collect()}
    rows = {x["chunk_id"]: x for x in c.select("chunk_id", "file_path", xref.symbols(F.col("content")).alias("s")).collect()}
    words = {x["chunk_id"]: set(x["i"]) for x in c.select("chunk_id", F.regexp_extract_all("content", F.lit(r"[A-Za-z_$][A-Za-z0-9_$]*|/api/region/\d+"), F.lit(0)).alias("i")).collect()}
    wanted = {s for k in range(3) for s in rows[k]["s"]} | {"/api/region/0"}
    first = {k for k in rows if k > 2 and words[k] & wanted}
    assert {k for k, h in got.items() if h == 0} == first
    assert all(h in (0, 1) for h in got.values()) and not set(got) & {0, 1, 2}


def test_a_million_near_ties(spark):
    """All rows in one bucket: no list of them is made, and the preferred ones come first."""
    rows = spark.range(1_000_000).select("id", (F.lit(0.5) + F.col("id") * 1e-9).alias("similarity"), (F.col("id") % 100_000 == 7).alias("preferred"))
    got = [x["id"] for x in vector.near_tie(rows, 8, "preferred", "id").orderBy("rank").collect()]
    assert got == [900_007 - 100_000 * k for k in range(8)]


def test_more_than_a_thousand_grants(spark):
    roots = [(k, f"/disk/{k}") for k in range(2500)] + [(3000, "/"), (2999, "/disk/7/deep/")]
    paths = [("/disk/2400/a",), ("/disk/2400",), ("/disk/24000/a",), ("/disk/7/deep/x",), ("elsewhere",), (None,), ("/disk/2400/a",)]
    got = lookup.first_grant(spark.createDataFrame(paths, "path string"), spark.createDataFrame(roots, "grant_no int, root string")).collect()
    want = {"/disk/2400/a": 2400, "/disk/2400": 2400, "/disk/24000/a": 3000, "/disk/7/deep/x": 7, "elsewhere": None, None: None}
    assert sorted((str(x["path"]), x["grant_no"]) for x in got) == sorted((str(p), want[p]) for (p,) in paths)
    entries = spark.createDataFrame([(k, "indexed") for k in range(2500)] + [(9999, "indexed")], "root_id int, status string")
    known = spark.createDataFrame([(k,) for k in range(2500)] * 2, "root_id int")
    assert {(x["status"], x["n"]) for x in lookup.with_root(entries, known).groupBy("status").agg(F.count("*").alias("n")).collect()} == {("indexed", 2500), ("unsafe", 1)}


def plain_expansion(rows, found, best, k):
    """XREF-12 by loops: rows by id, and what each chunk shows of each identifier (found: id to symbol to category)."""
    import re

    from tarn.operators import xref

    file_of = lambda i: rows[i]["file_path"].lower()
    impl = lambda i: rows[i]["file_path"].rsplit(".", 1)[-1] in xref.IMPLEMENTATION
    weak = lambda s: re.fullmatch("[a-z][a-z0-9]*", s) is not None
    rank = lambda cat, s: 3 if cat == "definition" and weak(s) else xref.RANK[cat]

    def rounds(seeds, column, each):
        out, k = [], 0
        while True:
            new = [rows[i][column][k] for i in seeds if k < min(len(rows[i][column]), each)]
            fresh = [x for x in dict.fromkeys(new) if x not in out]
            if not fresh:
                return out[: xref.MAX_SYMBOLS]
            out, k = out + fresh, k + 1

    def hop(seeds, seen):
        names, routes = ([x for x in rounds(seeds, c, n) if x not in seen] for c, n in (("symbols", xref.MAX_SYMBOLS_CHUNK), ("routes", xref.MAX_ROUTES_CHUNK)))
        out = {}
        for i in rows:
            shown = [(rank(found[i][s], s), p, s, found[i][s]) for p, s in enumerate(names) if s in found[i]]
            told = [(xref.RANK["route"], r) for r in routes if re.search(re.escape(r) + r"(?![A-Za-z0-9_/-])", rows[i]["content"])]
            both = [(min(shown)[0], min(shown)[2], min(shown)[3])] if shown else []
            both += [(told[0][0], told[0][1], "route")] if told else []
            if both:
                out[i] = min(both)[1:]
        return out, seen | set(names) | set(routes)

    selected = sorted(best, key=lambda i: (-rows[i]["similarity"], i))
    seeds = [i for i in selected if impl(i)] or selected
    defined = {s for s in rounds(seeds, "symbols", xref.MAX_SYMBOLS_CHUNK) for i in selected if found[i].get(s) == "definition"}
    told = set(rounds(selected, "routes", xref.MAX_ROUTES_CHUNK))
    first, seen = hop(seeds, set())
    first = {i: m for i, m in first.items() if i not in seeds}
    strong = sorted((i for i, (s, cat) in first.items() if impl(i) and cat in ("definition", "call", "route")), key=lambda i: (rank(first[i][1], first[i][0]), i))[: xref.MAX_SEEDS]
    second, _ = hop(sorted(strong), seen)
    matches = {i: (*m, 0, file_of(i) not in {file_of(x) for x in seeds}) for i, m in first.items()}
    matches |= {i: (*m, 1, file_of(i) not in {file_of(x) for x in strong}) for i, m in second.items() if i not in seeds and i not in first}
    pool = []
    for i in selected:
        pool.append((not (impl(i) and not rows[i]["types"]), -((250 if rows[i]["types"] else 800 if impl(i) else 200) + rows[i]["similarity"]), i, "semantic"))
    for i, (s, cat, n, crossed) in matches.items():
        if i in selected:
            continue
        own = {"definition": 120, "call": 110, "route": 110, "import": 70, "reference": 8}["reference" if cat == "definition" and weak(s) else cat] * (0.5 if n else 1)
        known = s in defined
        own += 40 * crossed - 80 * (not impl(i)) + 50 * (not n) + 60 * (not n and cat == "definition" and not known) - 55 * (cat == "definition" and known) - 60 * (cat == "import" and known)
        own += 110 * (n > 0 and cat == "call" and not weak(s)) + 110 * (not n and cat == "call" and crossed and known and not weak(s)) + 110 * (cat == "route" and crossed and s in told)
        own -= 80 * (file_of(i) in {file_of(x) for x in selected} and cat != "definition")
        own += 110 * (not n and ("reference" if cat == "definition" and weak(s) else cat) in ("call", "reference") and rows[i]["options"])
        pool.append((True, -(min(790, 520 + own + rows[i]["similarity"]) if impl(i) else 120 + rows[i]["similarity"]), i, "xref"))
    pool.sort(key=lambda x: (x[0], round(x[1], 9), -rows[x[2]]["similarity"], file_of(x[2]), rows[x[2]]["start_line"], rows[x[2]]["end_line"]))
    merged, held = [], {}
    for _, _, i, origin in pool:
        if len(merged) < k and held.get(file_of(i), 0) < xref.PER_FILE:
            held[file_of(i)] = held.get(file_of(i), 0) + 1
            merged.append((i, origin))
    if len(merged) < min(k, len(selected)):
        merged += [(i, "semantic") for i in selected if i not in dict(merged)][: k - len(merged)]
    return merged


def test_expanded_results(spark):
    from tarn.functions.text import api_routes
    from tarn.operators import compose, xref
    from tarn.sources.tables import code_chunks

    c = code_chunks(spark, "/root/testdata/sf0.001")
    types = spark.createDataFrame([(900, "src/types.ts", 1, 2, "export interface Row_Set { a: load_brazil }", 0.95), (901, "readme.md", 1, 2, "see load_peru and fetchRegion1", 0.9), (902, "py/region_1.py", 90, 93, "def other_thing():\n    return fetchRegion1('/api/region/1')", 0.05)], c.schema)
    c = c.unionByName(types)
    told = c.withColumn("symbols", xref.symbols(F.col("content"))).withColumn("routes", api_routes(F.col("content"))).withColumn("types", xref.type_only(F.col("file_path"), F.col("content"))).withColumn("options", xref.options_call(F.col("content")))
    rows = {x["chunk_id"]: x for x in told.collect()}
    found = {i: {} for i in rows}
    for x in xref.occurrences(c).collect():
        found[x["chunk_id"]][x["symbol"]] = x["raw_category"]
    for best, k in (([0, 1, 2, 900, 901], 8), ([901], 4), ([2, 5, 8, 11], 4), ([3], 1)):
        got = compose.expand_results(c.where(F.col("chunk_id").isin(best)), c, k).orderBy("rank").collect()
        assert [(x["chunk_id"], x["origin"]) for x in got] == plain_expansion(rows, found, best, k), best


def test_index_of_many_names_is_whole(spark, tmp_path):
    """More names than a hop asks for: the first ones by round; a symbol of a third of all chunks; an index opened again."""
    from tarn.operators import symbol_index, xref

    rows = [(k, f"src/f{k % 7}.js", 1, 9, f"function make_{k}() {{ return shared_name({', '.join(f'part_{(k + j) % 60}' for j in range(30))}); }}" if k % 3 else "function shared_name() {}", 0.1) for k in range(300)]
    chunks = spark.createDataFrame(rows, "chunk_id long, file_path string, start_line int, end_line int, content string, similarity double").repartition(3)
    symbol_index.build(chunks, str(tmp_path / "i"))
    index = symbol_index.opened(spark, str(tmp_path / "i"))
    asked, files = symbol_index.referred(index, [1, 2, 4, 5, 7])
    lists = {r["chunk_id"]: r["s"] for r in chunks.select("chunk_id", xref.symbols("content").alias("s")).collect()}
    want = []
    for j in range(16):
        for k in (1, 2, 4, 5, 7):
            if j < len(lists[k]) and lists[k][j] not in want:
                want.append(lists[k][j])
    assert asked.symbols == want[:40] and len(files) == 5
    wide, _ = symbol_index.referred(index, [1, 20, 40, 200, 250])
    assert len(wide.symbols) == 40
    got = {r["chunk_id"]: (r["symbol"], r["raw_category"]) for r in symbol_index.matches(index, symbol_index.Wanted(["shared_name", "make_4"], [])).collect()}
    assert len(got) == 300 and got[0] == ("shared_name", "definition") and got[4] == ("make_4", "definition") and got[5] == ("shared_name", "call")
    assert symbol_index.matches(index, symbol_index.Wanted([], [])).collect() == [] and symbol_index.expand(index, [9999]).collect() == []
