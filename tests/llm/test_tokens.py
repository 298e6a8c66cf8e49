"""Operators 2, 4 and 10 against the tokenizers library."""

import hashlib
import os
import random
import time
import zlib

os.environ["RAYON_NUM_THREADS"] = "1"
os.environ["TOKENIZERS_PARALLELISM"] = "false"

import numpy as np
import pytest
from tokenizers import Tokenizer

from tarn.llm import bpe, packing, token_counts
from tarn.llm.queries import byte_bpe

PIECES = [" ", "  ", "\n", "\t", "'s", "'t", "'re", "'ve", "'m", "'ll", "'d", "'", "''", "a", "ab", " the", "é", "1", "23", "½", "...", " ,", "<|endoftext|>", "<|", "|>", "😀", "日本", "'S", "\r\n", "\x00", "\x85", "aaaa", "0xdeadbeef", " ", "　"]


def texts(n):
    r = random.Random(7)
    long = ["x" * 20_000, " " * 3000, "ab" * 4000, "-" * 2500, "".join(r.choice("0123456789abcdefXYZ") for _ in range(9000))]
    return [None, "", " ", *["".join(r.choice(PIECES) for _ in range(r.randint(0, 14))) for _ in range(n)], *long, "same", "same"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(byte_bpe())


def test_counts_and_encoding(documents, library):
    ts = texts(1500)
    docs = documents(ts)
    counts = {x["doc_id"]: x for x in token_counts.token_counts(docs, byte_bpe()).collect()}
    coded = {x["doc_id"]: x for x in bpe.encode_decode(docs, byte_bpe()).collect()}
    for i, t in enumerate(ts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        assert (counts[i]["n_tokens"], counts[i]["n_bytes"], counts[i]["over_limit"]) == (len(ids), len((t or "").encode()), len(ids) > 1024), repr(t)
        assert (coded[i]["n_tokens"], coded[i]["ids_sha256"]) == (len(ids), hashlib.sha256(raw).hexdigest()), repr(t)
        assert coded[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_cache_that_starts_anew_changes_nothing(monkeypatch):
    t = token_counts.Transducer(bpe.codec(byte_bpe()))
    ts = texts(200)
    want = t.count([x or "" for x in ts])[1]
    monkeypatch.setattr(token_counts, "STATES_KEPT", 1)
    assert (t.count([x or "" for x in ts])[1] == want).all() and (t.count([x or "" for x in ts])[1] == want).all()


def test_state_maps_compose():
    """Random maps, tabled in part: the scan's entry states are those of a run from left to right, whatever it has to ask for."""
    r = random.Random(2)
    for size in [1, 2, 3, 5, 8, 33, 100]:
        whole = [{s: (r.randrange(9), r.randrange(5)) for s in range(9)} for _ in range(size)]
        asked = []

        def run(i, s, whole=whole, asked=asked):
            asked.append((i, s))
            return whole[i][s]

        tree = token_counts.MapTree([{s: m[s] for s in r.sample(range(9), 2)} for m in whole], run)
        for start in range(9):
            want, total, state = [], 0, start
            for m in whole:
                want.append(state)
                state, count = m[state]
                total += count
            assert tree.entries(start) == want and tree.apply(len(tree.levels) - 1, 0, start) == (state, total)
        assert len(asked) == len(set(asked)) <= 9 * size


def test_long_pretokens(library):
    """Texts without a pre-token start for many chunks, in several periods."""
    r = random.Random(4)
    t = token_counts.Transducer(bpe.codec(byte_bpe()))
    long = ["".join(r.choice(a) for _ in range(n)) for a in ("ab", "xyz", "0123456789", "=", "Aé日", "\n") for n in (127, 128, 129, 1000, 12_345)] + ["abc" * 5000 + " " + "q" * 700]
    assert t.count(long)[1].tolist() == [len(library.encode(x, add_special_tokens=False).ids) for x in long]


def test_packing(documents, library):
    ts = texts(400) + ["the quick brown fox " * 3000]
    rows = packing.pack_documents(documents(ts).repartition(3), byte_bpe(), group_tokens=20_000).collect()
    ids = {i: np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in enumerate(ts)}
    by_doc, by_sequence = {}, {}
    for x in rows:
        by_doc.setdefault(x["doc_id"], []).append(x)
        by_sequence.setdefault(x["sequence_id"], []).append(x)
        piece = ids[x["doc_id"]][x["start"] : x["start"] + x["length"]]
        assert x["doc_tokens"] == len(ids[x["doc_id"]]) and x["ids_crc32"] == zlib.crc32(piece.tobytes()) and len(piece) == x["length"] > 0
    assert set(by_doc) == set(ids)
    for i, found in by_doc.items():
        at = 0
        for x in sorted(found, key=lambda x: x["start"]):
            assert x["start"] == at
            at += x["length"]
        assert at == len(ids[i])
    padding = 0
    for found in by_sequence.values():
        at = 0
        for x in sorted(found, key=lambda x: x["offset"]):
            assert x["offset"] == at
            at += x["length"]
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding < 2048 * (3 + sum(map(len, ids.values())) // 20_000)  # one window a group
    steps = {}
    for found in by_sequence.values():
        steps[found[0]["step_group"]] = steps.get(found[0]["step_group"], 0) + sum(x["length"] for x in found)
    assert max(steps.values()) <= packing.STEP_TOKENS + 2048


def test_pack_fills_windows():
    r = random.Random(1)
    sizes = [r.choice([1, 5, 100, 255, 256, 257, 700, 1500, 2048, 5000]) for _ in range(300)]
    windows = packing.pack(sizes)
    assert sum(p[2] for _, c in windows for p in c) == sum(sizes)
    assert sum(sum(p[2] for p in c) != tier for tier, c in windows) <= 1
    assert packing.pack([]) == [] and packing.pack([0]) == []


def test_very_many_short_texts():
    """A group of nothing but end ids: the pools don't slow down with the pieces they hold."""
    begin = time.process_time()
    windows = packing.pack([1] * 500_000)
    assert time.process_time() - begin < 20
    assert sum(len(c) for _, c in windows) == 500_000 and sum(sum(p[2] for p in c) != tier for tier, c in windows) <= 1


def test_packed_ids_when_words_are_forgotten(monkeypatch, library):
    monkeypatch.setattr(packing, "KNOWN_WORDS", 3)
    e = packing.Encoder(byte_bpe())
    for t in texts(60):
        assert e.ids([t or ""])[0].tolist() == [*library.encode(t or "", add_special_tokens=False).ids, 1], repr(t)


def test_empty(documents):
    for f in (lambda d: token_counts.token_counts(d, byte_bpe()), lambda d: bpe.encode_decode(d, byte_bpe()), lambda d: packing.pack_documents(d, byte_bpe())):
        assert f(documents([])).collect() == []
