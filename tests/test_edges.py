"""Literal edge cases."""

import math
import datetime as dt

import pytest
from pyspark.sql import functions as F

from tarn.functions import numbers, text
from tarn.operators import diagnostics, memory, storage, vector, xref


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1).alias("x")])
    return row.select(column.alias("r")).first()["r"]


def test_cosine(spark):
    def cos(a, b):
        df = spark.createDataFrame([(a, b)], "a array<double>, b array<double>")
        return df.select(vector.cosine(F.col("a"), F.col("b"))).first()[0]

    assert cos([0.0, 0.0], [1.0, 1.0]) == 0 and cos([1.0, 2.0], [2.0, 4.0]) == pytest.approx(1) and cos([1.0], [-1.0]) == -1


def test_other_lengths(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0])], "id int, embedding array<double>")
    q = df.where("id = 1")
    assert [x["id"] for x in vector.score(df, q, skip_other_lengths=True).collect()] == [1]
    with pytest.raises(Exception, match="differ in length"):
        vector.score(df, q).collect()


def test_valid(spark):
    rows = [([1.0],), ([],), ([float("nan")],), ([float("inf")],), ([None],), (None,)]
    df = spark.createDataFrame(rows, "v array<double>")
    assert [x[0] for x in df.select(vector.valid(F.col("v"))).collect()] == [True, False, False, False, False, False]


def test_text(spark):
    assert one(spark, text.normalize(F.lit("a\r\nb\rc\n\n\n\nd\0"))) == "a\nb\nc\n\nd"
    assert one(spark, text.preview(F.lit("\u00a0 a \ufeff b "))) == "a b"
    assert one(spark, text.clamp(F.lit("x" * 281), 280)) == "x" * 279 + "…" and one(spark, text.clamp(F.lit("x" * 280), 280)) == "x" * 280
    assert one(spark, text.scrub(F.lit("see C:\\Users\\me\\a.txt or /home/me/x, a.b@c.org 10.0.0.1"))) == "see [path] or [path] [email] [ip]"
    assert one(spark, text.scrub(F.lit(None).cast("string"))) == ""
    assert one(spark, text.extension(F.lit("a/.env"))) == "" and one(spark, text.extension(F.lit("a/b.TAR.Gz"))) == "gz"
    assert one(spark, text.after_thinking(F.lit("<think>x</think> y </think> z"))) == "z"
    assert one(spark, text.ancestors(F.lit("a/b/c"))) == ["a", "a/b"] and one(spark, text.ancestors(F.lit("c"))) == []
    assert one(spark, text.inside(F.lit("/a/bc"), F.lit("/a/b"))) is False and one(spark, text.inside(F.lit("/a/b/c"), F.lit("/a/b"))) is True
    assert one(spark, text.api_routes(F.lit("'/api/x/' \"/api/x\" `GET /api/y/z` '/api/")))[:1] == ["/api/x"]
    assert one(spark, text.names_match(F.lit("App.exe"), F.lit("c:\\dir\\app.dll"))) is True and one(spark, text.names_match(F.lit("app"), F.lit(None).cast("string"))) is False


def test_numbers(spark):
    assert one(spark, numbers.half_up(F.lit(-2.5))) == -2 and one(spark, numbers.half_up(F.lit(2.5))) == 3
    assert one(spark, numbers.used_percent(F.lit(1.0), F.lit(0.0))) is None
    assert one(spark, numbers.to_time(F.lit("/Date(0)/"))) == dt.datetime(1970, 1, 1) and one(spark, numbers.to_time(F.lit("later"))) is None
    assert one(spark, numbers.finite(F.lit("Infinity"))) is None and one(spark, numbers.finite(F.lit("2.5"))) == 2.5


def test_time_windows():
    sunday, monday = dt.datetime(2024, 3, 10, 12), dt.datetime(2024, 3, 11, 0)
    assert memory.window_of("this week", sunday)[0] == dt.datetime(2024, 3, 4) and memory.window_of("this week", monday)[0] == dt.datetime(2024, 3, 11)
    assert memory.window_of("last month", dt.datetime(2024, 1, 31))[:2] == (dt.datetime(2023, 12, 1), dt.datetime(2023, 12, 31, 23, 59, 59, 999000))
    assert memory.window_of("last march", dt.datetime(2024, 3, 5))[0] == dt.datetime(2023, 3, 1) and memory.window_of("last january", dt.datetime(2024, 3, 5))[0] == dt.datetime(2024, 1, 1)
    assert memory.window_of("december 2023", monday)[1].day == 31
    assert memory.window_of("thirty days ago", dt.datetime(2024, 3, 31))[2] == "30 days ago" and memory.window_of("forty days ago", monday) is None
    assert memory.window_of("2 weeks ago", monday)[1].date() == monday.date()
    assert memory.without_time("What did I say yesterday about  tea three days ago?") == "What did I say about tea ?"


def test_phrases():
    assert memory.phrases_of("What was my OfferCheck idea?") == (["OfferCheck"], ["OfferCheck"])
    assert memory.phrases_of("tell me about the blue kettle") == (["blue kettle"], ["blue kettle"])
    assert memory.phrases_of("what is tea") == (["tea"], []) and memory.phrases_of("") == ([], [])
    assert memory.distinctive("a1bc") and not memory.distinctive("table") and not memory.distinctive("table7"[:3])


def test_boost(spark):
    def boost(hay, user, prefer=True):
        return one(spark, memory.phrase_boost(F.lit(hay), F.lit(user), "what was my blue kettle idea?", prefer))

    assert boost("", "") == 0
    assert boost("my idea called blue kettle helps", "my idea called blue kettle helps") == pytest.approx(0.28)
    assert boost("what was blue kettle", "what was blue kettle") == pytest.approx(0.06 - 0.25)
    assert boost("the blue kettle", "") == pytest.approx(0.06)
    assert boost("on blue kettle", "on blue kettle", False) == pytest.approx(0.10)


def test_excerpts_drop_broken_chunks(spark):
    m = spark.createDataFrame([(1, "a", "user", "hello")], "conversation_id int, message_id string, role string, content string")
    seg = "segments array<struct<conversation_id:int,message_id:string,start_char:int,end_char:int>>"
    c = spark.createDataFrame([(1, [(1, "a", 1, 3)]), (2, [(1, "a", 0, 9)]), (3, [(1, "a", 0, 1), (1, "b", 0, 1)])], f"k int, {seg}")
    assert [(x["k"], x["excerpt"]) for x in memory.excerpts(c, m, "k").collect()] == [(1, "el")]


def test_patch_can_set_null_and_refuses_keys(spark):
    m = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, content string")
    p = spark.createDataFrame([("a", None, True), ("b", "z", False)], "id string, content string, set_content boolean")
    assert sorted((x["id"], x["content"]) for x in memory.patch(m, p, "id", ["content"]).collect()) == [("a", None), ("b", "y")]
    with pytest.raises(ValueError):
        memory.patch(m, p, "id", ["id"])


def test_index_status_order(spark):
    schema = "root_id string, absolute_path string, extension string, size long, fingerprint string, extractor_version int, embedding_model string, validation string, extract_error string, text string"
    rows = [("r", p, e, s, "f", 1, "m", v, x, t) for p, e, s, v, x, t in [("a", "bin", 1, "stale", None, "t"), ("b", "txt", 1 << 40, "stale", None, "t"), ("c", "txt", 1, "stale", None, "t"), ("d", "txt", 1, "stale", "e", "t"), ("e", "txt", 1, None, "e", "t"), ("f", "txt", 1, None, None, " "), ("g", "txt", 1, None, None, "t")]]
    prev = [("r", "c", "f", "reused", 1, "m"), ("r", "g", "f", "error", 1, "m"), ("r", "a", "f", "indexed", 1, "m")]
    got = storage.index_status(spark.createDataFrame(rows, schema), spark.createDataFrame(prev, "root_id string, absolute_path string, fingerprint string, status string, extractor_version int, embedding_model string"))
    assert {x["absolute_path"]: x["status"] for x in got.collect()} == {"a": "unsupported", "b": "too_large", "c": "reused", "d": "stale", "e": "error", "f": "no_text", "g": "indexed"}


def test_eligibility(spark):
    base = dict(copy_integrity="verified", source_integrity="verified", destination_integrity="verified", source_authorization="authorized", cloud_safety="safe", dependency="clear")
    cases = [({}, True, False, "eligible_for_review"), ({"dependency": "uncertain"}, True, False, "requires_manual_review"), ({}, False, False, "requires_manual_review"), ({"copy_integrity": "unknown"}, True, False, "verification_failed"), ({"cloud_safety": "unsafe"}, True, False, "verification_failed"), ({}, True, True, "excluded"), ({"copy_integrity": "failed"}, True, True, "excluded")]
    for change, removable, excluded, want in cases:
        assert one(spark, storage.eligibility(F.lit(removable), F.lit(excluded)), **(base | change)) == want


def test_volume_match_compares_what_is_known(spark):
    m = spark.createDataFrame([("v", None, "d"), ("v", "s", None), ("v", "x", None), ("w", None, None)], "volume_id string, serial string, disk string")
    v = spark.createDataFrame([("v", "s", None, "high", "NTFS")], "volume_id string, serial string, disk string, identity_confidence string, file_system string")
    assert [x["match_code"] for x in storage.volume_match(m, v).orderBy("volume_id", "serial").collect()] == ["OK", "OK", "IDENTITY_CHANGED", "DRIVE_GONE"]


def test_conflicts(spark):
    e = spark.createDataFrame([(1, "/A"), (2, "/a"), (3, "/b"), (4, "/a")], "id int, d string")
    assert sorted((x["id"], x["first_id"], x["is_first"]) for x in storage.destination_conflicts(e, "id", "d").collect()) == [(1, 1, True), (2, 1, False), (4, 1, False)]


def test_gates(spark):
    gate = storage.removal_gate([("A", F.col("a")), ("B", F.col("b"))])
    assert one(spark, gate, a=True, b=True) == "ready" and one(spark, gate, a=True, b=False) == "B" and one(spark, gate, a=False, b=False) == "A"


def test_pid_reuse_is_a_restart(spark):
    rows = [(1, 10, 0, 5.0, 1.0, True), (1, 10, 1, 7.0, 2.0, None), (1, 20, 2, 3.0, 0.0, False), (2, 10, 2, 1.0, 1.0, True)]
    s = spark.createDataFrame(rows, "pid int, started_at int, at int, memory double, cpu double, responding boolean")
    got = {(x["pid"], x["started_at"]): (x["peak_memory"], x["last_memory"], x["ever_not_responding"], x["disappeared"], x["restarted"]) for x in diagnostics.identity_state(s, F.lit(2)).collect()}
    assert got == {(1, 10): (7.0, 7.0, False, True, True), (1, 20): (3.0, 3.0, True, False, False), (2, 10): (1.0, 1.0, False, False, False)}


def test_activity_tail_limits(spark):
    lines = spark.createDataFrame([(i, '{"k": %d}' % i if i != 250 else "{bad") for i in range(260)], "i int, line string")
    tail = lambda n: [x["i"] for x in diagnostics.activity_tail(lines, "i", "line", "k int", n).orderBy(F.desc("i")).collect()]
    assert tail(3) == [259, 258, 257] and len(tail(0)) == 100 and len(tail(500)) == 100 and len(tail(200)) == 199 and 250 not in tail(200)


def test_symbols(spark):
    code = "import { alpha as betaTwo } from './x';\nexport async function loadAll(a) { // makeNoise(\n  return fetchIt(a, 'callMe(');\n}\nconst my_rows = 1;"
    assert one(spark, xref.symbols(F.lit(code))) == ["loadAll", "my_rows", "alpha", "betaTwo", "fetchIt"]
    assert one(spark, xref.symbols(F.lit(""))) == []


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "id int, embedding array<double>, label int, similarity double, preferred boolean, file string")
    assert vector.near_tie(empty, 5, "preferred", "id").count() == 0
    assert vector.diversify(empty, 5, "file", "id").count() == 0
    assert vector.score(empty, empty).count() == 0


CODE = {
    "export default async function loadAll(a) { return fetchIt(a); }": ["loadAll", "fetchIt"],
    "import { alphaOne, betaTwo as gammaThree } from 'x'": ["alphaOne", "betaTwo", "gammaThree"],
    "from pkg.sub import first_thing, second_thing as other_thing": ["first_thing", "second_thing", "other_thing"],
    "class HttpServer:\n    def handle_request(self): pass": ["HttpServer", "handle_request"],
    "// const hiddenName = 1\nconst shownName = 2": ["hiddenName", "shownName"],
    "x.methodCall(1); plainCall(2)": ["plainCall", "methodCall"],
    "const s = 'quotedCall(1)'": [],
    "export { oneThing, twoThing as three_thing }": ["oneThing", "twoThing", "three_thing"],
    "let $store = useStore()": ["$store", "useStore"],
    "if (ready) { while (more) { return; } }": [],
    "/* oldCall() */ newCall()": ["newCall"],
    "def a_b(x):\n    return c_d(x) + e_f": ["a_b", "c_d", "e_f"],
}


def test_symbols_of_varied_code(spark):
    rows = spark.createDataFrame([(k, c) for k, c in enumerate(CODE)], "id int, code string")
    got = {x["id"]: x["s"] for x in rows.select("id", xref.symbols(F.col("code")).alias("s")).collect()}
    assert [got[k] for k in range(len(CODE))] == list(CODE.values())


def test_batch_search_in_blocks(spark, monkeypatch):
    """More queries than are broadcast: the same neighbours, by an equi-join."""
    rows = spark.createDataFrame([(i, [float(i % 7), 1.0, i / 9]) for i in range(40)], "vec_id long, embedding array<double>")
    found = lambda: sorted(map(tuple, vector.knn(rows, rows, 3, "vec_id").collect()))
    want = found()
    monkeypatch.setattr(vector, "KNN_QUERIES", 7)
    assert found() == want and len(want) == 120
    assert "NestedLoop" not in vector.knn(rows, rows, 3, "vec_id")._jdf.queryExecution().toString()


def test_batch_search_against_a_plain_loop(spark, monkeypatch):
    """Copies, vectors without length, null ones and null components, in several blocks and shares; a matrix does the work."""
    import random

    rng = random.Random(8)
    vectors = [[rng.choice([-1.0, 0.1, 0.3]) for _ in range(5)] for _ in range(40)]
    rows = [(i, rng.choice(vectors)) for i in range(3000)] + [(3000, [0.0] * 5), (3001, None), (3002, [1.0, None, 1.0, 1.0, 1.0])]
    monkeypatch.setattr(vector, "KNN_QUERIES", 2)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = [0, 7, 3000, 3001]
    found = vector.knn(df.where(F.col("vec_id").isin(asked)), df, 4, "vec_id")
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().toString()
    got = {}
    for x in found.orderBy("query", "rank").collect():
        got.setdefault(x["query"], []).append((x["vec_id"], x["similarity"]))

    def cosine(a, b):
        if a is None or b is None or None in a or None in b:
            return None
        dot, na, nb = 0.0, 0.0, 0.0
        for x, y in zip(a, b, strict=True):
            dot, na, nb = dot + x * y, na + x * x, nb + y * y
        return 0.0 if na == 0 or nb == 0 else dot / (math.sqrt(na) * math.sqrt(nb))

    for a in asked:
        want = sorted(((-9 if (c := cosine(dict(rows)[a], v)) is None else c, i) for i, v in rows if i != a), key=lambda x: (-x[0], x[1]))[:4]
        assert got[a] == [(i, None if c == -9 else c) for c, i in want], a
