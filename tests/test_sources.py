"""File sources, versioned tables, providers and tools."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tarn.operators import embedding
from tarn.plans.tools import TOOLS
from tarn.sources import files, walk
from tarn.sources.versions import Conflict, VersionedTable


def test_scan_and_project(spark, tmp_path):
    for name, content in {"a.js": b"let x\r\n", "sub/b.py": b"y", "sub/.env": b"k=1", "node_modules/c.js": b"z", "big.ts": b"x" * 500_001, "d.bin": b"\x00", "package-lock.json": b"{}", "B.JS": b"up", ".hidden.py": b"h", "_under.ts": b"u", "sub/empty.css": b"", "NODE_modules/x.js": b"no"}.items():
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(content)
    found = {r["relative_path"]: (r["size"], r["extension"]) for r in files.scan_files(spark, str(tmp_path)).collect()}
    assert found["sub/b.py"] == (1, "py") and len(found) == 12
    assert {r["relative_path"]: r["text"] for r in files.project_files(spark, str(tmp_path)).collect()} == {"a.js": "let x\r\n", "sub/b.py": "y", "B.JS": "up", ".hidden.py": "h", "_under.ts": "u", "sub/empty.css": ""}


def test_read_text_refuses_binary_and_large(spark):
    rows = spark.createDataFrame([("a", bytearray(b"x\r\ny")), ("b", bytearray(b"x\x00")), ("c", bytearray(b"x" * 11)), ("d", bytearray(b"\x10\x01"))], "path string, content binary")
    assert {r["path"]: (r["text"], r["error"]) for r in files.read_text(rows, 10).collect()} == {"a": ("x\ny", None), "b": (None, "binary"), "c": (None, "too_large"), "d": ("\x10\x01", None)}


def docx(*paragraphs):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return bytearray(out.getvalue())


def test_extract(spark):
    rows = spark.createDataFrame([("a", "text", bytearray("é\r".encode())), ("b", "docx", docx("one", "two")), ("c", "docx", bytearray(b"no zip")), ("d", "pdf", bytearray(b"")), ("e", "pages", bytearray(b"p"))], "path string, kind string, content binary")
    got = {r["path"]: (r["text"], r["error"]) for r in files.extract(rows, {"pages": lambda raw: "from pages"}).collect()}
    assert got == {"a": ("é\n", None), "b": ("one\n\ntwo", None), "c": (None, "docx_extract_failed: BadZipFile"), "d": (None, "unsupported"), "e": ("from pages", None)}


def test_page_spans(spark):
    p = spark.createDataFrame([(1, 1, "abc"), (1, 2, ""), (1, 3, "de")], "d int, page int, text string")
    assert [(r["span_start"], r["span_end"]) for r in files.page_spans(p, "d", "page", "text").orderBy("page").collect()] == [(0, 3), (5, 5), (7, 9)]


def test_lines_and_journal(spark, tmp_path):
    folder = str(tmp_path / "log")
    files.append_lines(spark.createDataFrame([(1, "a")], "id int, type string"), folder)
    files.append_lines(spark.createDataFrame([(2, "b")], "id int, type string"), folder)
    (tmp_path / "log" / "part-bad.json").write_text("{broken\n")
    assert sorted(r["id"] for r in files.read_lines(spark, folder, "id int, type string").collect()) == [1, 2]
    j = files.journal(spark.createDataFrame([(None, "s"), (2, "s"), (2, None)], "schema_version int, manifest_snapshot string"))
    assert [(r["schema_version"], r["has_snapshot"]) for r in j.collect()] == [(1, False), (2, True), (2, False)]


def test_versions(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "index"))
    with pytest.raises(FileNotFoundError):
        t.read()
    one = spark.range(3)
    assert t.publish(one, "m", expected=0) == 1 and t.publish(spark.range(5), "m", expected=1) == 2
    assert t.read("m").count() == 5
    with pytest.raises(RuntimeError):
        t.publish(one, "m", expected=1)
    with pytest.raises(ValueError):
        t.read("other")


def test_archive_and_corpus(spark):
    good = "0b5fd1b8-9d3c-4c1e-8f55-3a0f6a3d2a11"
    manifest = spark.createDataFrame([(good, "t"), ("../x", "t")], "id string, ended_at string")
    m = spark.createDataFrame([(good, "a"), ("../x", "b")], "conversation_id string, content string")
    kept = files.archive(manifest, m)
    assert [r["content"] for r in kept.collect()] == ["a"]
    assert sorted((r["content"], r["current"]) for r in files.corpus(kept, m).collect()) == [("a", False), ("a", True), ("b", True)]


def test_providers(spark):
    rows = spark.createDataFrame([(i, f"t{i}" if i else None) for i in range(40)], "id int, text string")
    sizes = []
    embedding.register("length", lambda ts: [[float(len(t)), 1.0] for t in ts])
    got = {r["id"]: r["embedding"] for r in embedding.embed(rows, "id", "text", "length").collect()}
    assert got[0] == [0.0, 1.0] and got[12] == [3.0, 1.0] and len(got) == 40 and not sizes
    with pytest.raises(Exception, match="the provider gave"):
        embedding.embed(rows, "id", "text", lambda ts: [[1.0]]).collect()


def test_hashed_embedding(spark):
    df = spark.createDataFrame([("red fox", "fox RED"), ("", None), ("a", "b")], "a string, b string")
    rows = df.select(embedding.hashed(F.col("a")).alias("a"), embedding.hashed(F.col("b")).alias("b")).collect()
    assert rows[0]["a"] == rows[0]["b"] and sum(x * x for x in rows[0]["a"]) == pytest.approx(1)
    assert set(rows[1]["a"]) == set(rows[1]["b"]) == {0.0} and rows[2]["a"] != rows[2]["b"]


def test_hashed_embedding_splits_a_text_once(spark):
    """However many dimensions: what an expression uses twice is computed twice, so the words are bound once."""
    df = spark.createDataFrame([("red fox " * 20_000,)], "a string")
    found = df.select(embedding.hashed(F.col("a")).alias("e"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert sum(x * x for x in found.first()["e"]) == pytest.approx(1)


def test_tools(spark, sf):
    assert TOOLS["inspect_disk_usage"](spark, sf, top=3).count() == 3
    assert TOOLS["search_files"](spark, sf, query="file_1").count() > 0
    listed = TOOLS["list_directory"](spark, sf, path="thther.example.org", max_depth=4)
    assert "truncated" in listed.columns
    for given in ({"top": 0}, {"top": "x"}, {"top": True}, {"other": 1}):
        with pytest.raises(ValueError):
            TOOLS["inspect_disk_usage"](spark, sf, **given)
    with pytest.raises(ValueError):
        TOOLS["search_files"](spark, sf)
    with pytest.raises(PermissionError):
        TOOLS["run_shell"](spark, sf)


def test_streamed_append_adds_each_row_once(spark, tmp_path):
    from tarn.streaming import streams

    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id int, v string").write.parquet(source)
    for k in range(2):  # a second stream over the same rows adds nothing
        streams.append_table(spark.readStream.schema("id int, v string").parquet(source), target, "id", str(tmp_path / f"check{k}"))
    assert sorted(r["id"] for r in spark.read.parquet(target).collect()) == [1, 2]


def test_append_reads_touched_buckets_only(spark, tmp_path):
    """A batch of one key leaves the other buckets unread: they hold rubbish then."""
    import glob
    import os

    from tarn.streaming import streams

    target = str(tmp_path / "out")

    def add(k, rows):
        source = str(tmp_path / f"in{k}")
        spark.createDataFrame(rows, "id int, v string").write.parquet(source)
        streams.append_table(spark.readStream.schema("id int, v string").parquet(source), target, "id", str(tmp_path / f"check{k}"), 16)

    add(0, [(i, "a") for i in range(100)] + [(None, "n")])
    bucket = spark.read.parquet(target).where("id = 7").first()["key_bucket"]
    for f in glob.glob(f"{target}/key_bucket=*/*.parquet"):
        if f"key_bucket={bucket}/" not in f:
            os.rename(f, f + ".aside")
            with open(f, "w") as g:
                g.write("rubbish")
    add(1, [(7, "b"), (7, "c")])
    for f in glob.glob(f"{target}/key_bucket=*/*.aside"):
        os.replace(f, f[: -len(".aside")])
        crc = os.path.join(os.path.dirname(f), f".{os.path.basename(f)[: -len('.aside')]}.crc")
        if os.path.exists(crc):
            os.remove(crc)
    add(2, [(None, "m"), (200, "d")])
    add(3, [])
    got = sorted(((r["id"], r["v"]) for r in spark.read.parquet(target).collect()), key=str)
    assert got == sorted([(i, "a") for i in range(100)] + [(None, "n"), (200, "d")], key=str)
    with pytest.raises(ValueError):
        streams.append_table(spark.readStream.schema("id int, key_bucket int").parquet(str(tmp_path / "in0")), target, "id", str(tmp_path / "c"))


def test_last_lines_against_the_whole_file(tmp_path):
    import random

    r = random.Random(9)
    path = str(tmp_path / "log")
    for _ in range(400):
        text = "".join(r.choice(["a", "é", " ", "\n", "\n", "\r\n", "bcd"]) for _ in range(r.randint(0, 40)))
        with open(path, "wb") as f:
            f.write(text.encode())
        want = [t for x in text.split("\n") if (t := x.strip())][::-1]
        n, block = r.randint(1, 9), r.choice([1, 2, 3, 7, 64])
        assert walk.last_lines(path, n, block) == want[:n]


def test_tails_of_logs(spark, tmp_path):
    """Of a log of many gigabytes only its end is read; broken, blank and missing ones are told apart."""
    with open(tmp_path / "large", "wb") as f:  # holes take no disk
        f.seek(20 << 30)
        f.write(b"\n" + b"\n".join(b'{"k": %d}' % k if k % 3 else b"{broken" for k in range(300)))
    (tmp_path / "blank").write_bytes(b" \n\n")
    (tmp_path / "one").write_bytes(b'{"k": 5}\n\xff\n')
    paths = spark.createDataFrame([(str(tmp_path / n),) for n in ("large", "blank", "one", "none")], "path string")
    tails = {}
    for x in walk.tails(paths).orderBy("path", "back").collect():
        tails.setdefault(x["path"].rsplit("/", 1)[-1], []).append((x["line"], x["error"]))
    assert set(tails) == {"large", "one", "none"} and len(tails["large"]) == 200 and tails["none"] == [(None, "FileNotFoundError")]
    assert tails["one"] == [("\ufffd", None), ('{"k": 5}', None)] and tails["large"][0] == ('{"k": 299}', None)
    feed = {}
    for x in walk.feeds(paths, "k int", 4).orderBy("path", "position").collect():
        feed.setdefault(x["path"].rsplit("/", 1)[-1], []).append(x["record"]["k"])
    assert feed == {"large": [299, 298, 296, 295], "one": [5]}


def test_file_digests(spark, tmp_path):
    import hashlib

    content = {"a.bin": b"\x00\xff" * 70_000, "sub/b.txt": b"", "sub/c.txt": "é".encode()}
    for name, raw in content.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(raw)
    got = {r["path"].rsplit("/", 1)[-1]: (r["size"], r["sha256"]) for r in files.file_digests(spark, str(tmp_path)).collect()}
    assert got == {n.rsplit("/", 1)[-1]: (len(raw), hashlib.sha256(raw).hexdigest()) for n, raw in content.items()}


def test_digest_of_a_file_over_two_gigabytes(spark, tmp_path):
    import hashlib

    size = (2 << 30) + 12_345
    with open(tmp_path / "sparse.bin", "wb") as f:  # holes take no disk
        f.seek(size - 1)
        f.write(b"x")
    want = hashlib.sha256()
    for _ in range((size - 1) // (1 << 20)):
        want.update(bytes(1 << 20))
    want.update(bytes((size - 1) % (1 << 20)) + b"x")
    missing = spark.createDataFrame([(str(tmp_path / "sparse.bin"),), (str(tmp_path / "none"),)], "path string")
    got = {r["path"].rsplit("/", 1)[-1]: (r["size"], r["sha256"], r["error"]) for r in walk.digests(missing).collect()}
    assert got == {"sparse.bin": (size, want.hexdigest(), None), "none": (None, None, "FileNotFoundError")}


def test_walk_equals_the_file_system(spark, tmp_path):
    import os

    for k in range(150):  # more folders than subtrees, at several depths
        p = tmp_path / "root" / f"a{k % 5}" / f"b{k % 9}" / (".hid" if k % 4 == 0 else f"c{k % 7}") / f"{'._'[k % 2]}f{k}.Txt"
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"x" * (k % 3))
    root = tmp_path / "root"
    (root / "a0" / "Dist").mkdir()
    (root / "a0" / "Dist" / "in.js").write_text("no")
    (tmp_path / "outside.txt").write_text("o")
    os.symlink(tmp_path / "outside.txt", root / "link.txt")
    os.symlink(tmp_path, root / "a1" / "loop")
    os.mkfifo(root / "pipe")
    (root / "id_rsa").write_text("k")
    os.symlink(root, tmp_path / "alias")
    want = {}
    for folder, names, found in os.walk(root):
        for n in [*found, *names]:
            p = os.path.join(folder, n)
            kind = "link" if os.path.islink(p) else "ignored_directory" if n == "Dist" else "" if os.path.isdir(p) else None if os.path.isfile(p) else "not_a_file"
            if kind != "" and "/Dist/" not in p:
                want[os.path.relpath(p, root)] = (kind, os.lstat(p).st_size, os.lstat(p).st_mtime_ns // 1000)
    for subtrees in ("1", "7", "64"):
        spark.dataSource.register(walk.FolderWalk)
        rows = spark.read.format("folder_walk").option("ignored", '["dist"]').option("subtrees", subtrees).load(str(tmp_path / "alias")).withColumn("us", F.unix_micros("modified_at")).collect()
        assert {r["relative_path"]: (r["skipped"], r["size"], r["us"]) for r in rows} == want and len(rows) == len(want)
    found = walk.inventory(spark, f"file://{root}", ["dist"], lambda n: n == "id_rsa", depth=2)
    deep = {os.path.relpath(p, root) for p, _, _ in os.walk(root) if os.path.relpath(p, root).count("/") == 2 and "Dist" not in p}
    s = walk.summary(found).first()
    assert (s["files"], s["skipped_count"], s["error_count"], s["truncated"]) == (0, len(deep) + 5, 0, True)
    lost = walk.summary(walk.walk(spark, str(tmp_path / "nowhere"))).first()
    assert (lost["files"], lost["error_count"]) == (0, 1)


def test_racing_writers(spark, tmp_path):
    """Of writers that saw the same generation one wins, without an expectation all do, in turn; nothing is lost."""
    from concurrent.futures import ThreadPoolExecutor

    t = VersionedTable(spark, str(tmp_path / "race"))

    def one(k):
        try:
            return t.publish(spark.range(k, k + 1), "m", expected=0)
        except Conflict:
            return 0

    with ThreadPoolExecutor(8) as pool:
        assert sorted(pool.map(one, range(8))) == [0] * 7 + [1]
        assert len(t._listed("versions")) == 1 and t._listed("drafts") == []  # losers leave nothing
        assert sorted(pool.map(lambda k: t.publish(spark.range(k), "m"), range(6))) == [2, 3, 4, 5, 6, 7]


def test_updates_queries_and_old_versions(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "table"))
    assert t.update(lambda held: spark.range(3) if held is None else held, "m") == 1
    calls = []

    def slow(held):
        calls.append(held.count())
        if len(calls) == 1:  # another writer is faster once
            t.publish(spark.range(10), "m")
        return held.where("id % 2 = 0")

    assert t.update(slow, "m") == 3 and calls == [3, 10] and t.read().count() == 5
    with pytest.raises(Conflict):
        t.update(lambda held: t.publish(spark.range(1), "m") and held, "m", tries=1)
    seen = []

    def ask(rows):
        seen.append(rows.count())
        if len(seen) == 1:
            t.publish(spark.range(7), "m")
        return seen[-1]

    assert t.query(ask) == 7 and len(seen) == 2
    with pytest.raises(Conflict):
        t.query(lambda rows: t.publish(spark.range(2), "m"))
    spark.range(1).write.parquet(f"{t.folder}/versions/orphan")
    before = t.head()
    assert t.drop_versions(keep=1) == before["generation"] - 1 and t.read().count() == 2 and t.head() == before
    assert {n for n, _ in t._listed("versions")} == {before["version"], "orphan"}
    assert t.drop_versions(keep=1, orphans_after=-60) == 1 and len(t._listed("versions")) == 1


def test_archive(spark, tmp_path):
    target = VersionedTable(spark, str(tmp_path / "archive"))
    now = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "conversation_id string, position int, content string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "conversation_id string")
    held = lambda: sorted((r["conversation_id"], r["position"], r["content"]) for r in target.read().collect())
    assert files.archive_conversations(now, ids("a", "a"), target) == 1
    assert files.archive_conversations(now.withColumn("content", F.lit("changed")), ids("a", "b"), target) == 2
    assert held() == [("a", 1, "x"), ("a", 2, "y"), ("b", 1, "changed")]
    with pytest.raises(ValueError, match="without messages"):
        files.archive_conversations(now, ids("c"), target)
    files.forget_conversations(target, ids("a"))
    assert held() == [("b", 1, "changed")]
    files.forget_conversations(target)
    assert held() == []


def test_extracted_texts_leave_in_pieces(spark):
    """A batch of large texts is not held as a whole."""
    import weakref

    class Text(str):
        pass

    alive = weakref.WeakSet()

    def large(raw):
        text = Text(raw.decode() + "x" * 600_000)
        text.__class__.__hash__ = lambda t: id(t)
        alive.add(text)
        if len(alive) > 8:
            raise MemoryError
        return text

    rows = spark.range(40).coalesce(1).select(F.col("id").cast("string").alias("path"), F.lit("large").alias("kind"), F.col("id").cast("string").cast("binary").alias("content"))
    found = files.extract(rows.unionByName(rows.limit(1).select("path", F.lit("none").alias("kind"), "content")), {"large": large})
    got = found.select("path", F.length("text").alias("n"), "error").collect()
    assert len(got) == 41 and [r["error"] for r in got if r["error"]] == ["unsupported"] and {r["n"] - len(r["path"]) for r in got if r["n"]} == {600_000}
