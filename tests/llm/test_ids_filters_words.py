"""Token-ID files, the filter audit and spelling variants against brute force, the library and exact round trips."""

import itertools
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from ordinata.llm import filter_audit, queries, rans, spelling

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def test_coded_ids_come_back():
    """Whole blocks, ends of blocks, single steps and ids, from every checkpoint."""
    rng = np.random.default_rng(1)
    ids = rng.zipf(1.3, 300_000).clip(0, 49_407).astype(np.uint16)
    table = rans.Table.of_counts(np.bincount(ids))
    assert table.f.sum() == 1 << rans.SCALE and (table.f[np.unique(ids)] > 0).all()
    again = rans.Table.from_bytes(table.to_bytes())
    for n in (1, 31, 32, 33, 8191, 8192, 8193, 65_535, 65_536, 65_537, 300_000):
        blocks = list(rans.encode_blocks(ids[:n], table))
        assert (rans.decode_checkpoints([(b, 0, 8) for b in blocks], again) == ids[:n]).all()
    for k in range(8):
        assert (rans.decode_checkpoints([(blocks[1], k, k + 1)], table) == ids[65_536 + 8192 * k : 65_536 + 8192 * (k + 1)]).all()
    shares = np.bincount(ids) / len(ids)
    entropy = -(shares[shares > 0] * np.log2(shares[shares > 0])).sum() / 8
    assert sum(map(len, blocks)) < 1.06 * entropy * len(ids)


def test_tables_of_odd_counts():
    assert rans.Table.of_counts(np.array([0, 7])).f.tolist() == [0, 1 << rans.SCALE]
    skewed = rans.Table.of_counts(np.array([10**15, 1, 0, 1]))
    assert skewed.f.sum() == 1 << rans.SCALE and skewed.f[1] == skewed.f[3] == 1
    with pytest.raises(ValueError, match="symbols"):
        rans.Table.of_counts(np.zeros(3))


class Sink(bytearray):
    def write(self, data):
        self.extend(data)


def test_files_give_any_range_and_find_damage(tmp_path):
    rng = np.random.default_rng(2)
    table = rans.Table.of_counts(np.ones(300) * 5)
    docs = [rng.integers(0, 300, n).astype(np.uint32) for n in [1, 5, 70_000, 3, 200_000, *rng.integers(1, 400, 200), 1]]
    sink = Sink()
    writer = rans.FileWriter(sink, table, 7)
    for key, ids in enumerate(docs):
        writer.add(key or None, ids)
    writer.close()
    path = tmp_path / "f"
    path.write_bytes(sink)
    with path.open("rb") as store:
        reader = rans.FileReader(store, writer.at, table, 7)
        blocks = len(reader.directory)
        for step in (1, 2, blocks):
            got = [d for first in range(0, blocks, step) for d in reader.documents(first, min(blocks, first + step))]
            assert [g[0] for g in got] == [None, *range(1, len(docs))]
            assert [g[3] for g in got] == [zlib.crc32(d.astype("<u4").tobytes()) for d in docs]
        assert (reader.ids(70_004, 70_010) == np.concatenate(docs)[70_004:70_010]).all() and len(reader.ids(9, 9)) == 0
        with pytest.raises(rans.Corrupt):
            rans.FileReader(store, writer.at, table, 8)
    sink[int(reader.directory[1][0]) + 900] ^= 1
    path.write_bytes(sink)
    with path.open("rb") as store, pytest.raises(rans.Corrupt, match="block 1"):
        list(rans.FileReader(store, writer.at, table, 7).documents(0, 3))


def test_a_document_longer_than_a_batch(tmp_path, monkeypatch):
    monkeypatch.setattr(rans, "BATCH_BLOCKS", 2)
    ids = np.random.default_rng(4).integers(0, 50, 400_000).astype(np.uint32)
    table, sink = rans.Table.of_counts(np.ones(50)), Sink()
    writer = rans.FileWriter(sink, table, 1)
    writer.add(1, ids[:10])
    writer.add(2, ids)
    writer.add(3, ids[:5])
    writer.close()
    (tmp_path / "f").write_bytes(sink)
    with (tmp_path / "f").open("rb") as store:
        got = list(rans.FileReader(store, writer.at, table, 1).documents(0, 99))
    assert [(g[0], g[1], g[2]) for g in got] == [(1, 0, 10), (2, 10, 400_000), (3, 400_010, 5)]
    assert got[1][3] == zlib.crc32(ids.astype("<u4").tobytes())


def test_piecewise_ids_are_the_library_s():
    own, rng = rans.Pieces(queries.WORD_TOKENIZER), random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ'''  \n\t0123²¼_-.,<|>éÀß×÷µªº\xa0\x85\x1c\xad\x00漢字́Σσς🙂"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(5000)]
    texts += ["<|endoftext|> a", "x<|ENDOFTEXT|>", "I'll don't WE'VE 'S", "", " ", "x" * 3000, "é ́e"]
    assert [ids.tolist() for ids in own.many(pa.array(texts))] == [e.ids for e in own.exact.encode_batch(texts, add_special_tokens=False)]


@needs_tables
def test_stored_ids_are_those_of_plain_encoding(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    exact, start, want = Tokenizer.from_file(queries.WORD_TOKENIZER), 0, []
    for key in sorted(docs):
        ids = np.array([*exact.encode(docs[key] or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in queries.op11_rans_ids(spark, SF).collect()) == want


def test_id_files_of_many_parts(spark, tmp_path, monkeypatch):
    """Several files and ranges, rows without doc_id first, repeated rows, and a lost attempt's file that no manifest names."""
    monkeypatch.setattr(rans, "FILE_IDS", 2000)
    monkeypatch.setattr(rans, "RANGE_BLOCKS", 1)
    rows = [(i, f"alpha beta {i} gamma " * (i % 40)) for i in range(300)] + [(None, "no id"), (7, "seven again"), (8, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    (tmp_path / "part-000000-lost.rans").write_bytes(b"half a file")
    got = sorted(rans.store_and_read(df, queries.WORD_TOKENIZER, folder=f"file://{tmp_path}").collect(), key=lambda r: r["start"])
    exact = Tokenizer.from_file(queries.WORD_TOKENIZER)
    sizes = Counter((k, len(exact.encode(t or "", add_special_tokens=False).ids) + 1) for k, t in rows)
    assert Counter((r["doc_id"], r["n_tokens"]) for r in got) == sizes
    assert [r["doc_id"] for r in got] == sorted((k for k, _ in rows), key=lambda k: -1 if k is None else k)
    assert all(b["start"] == a["start"] + a["n_tokens"] for a, b in itertools.pairwise(got)) and got[0]["start"] == 0
    assert len(list(tmp_path.glob("part-*"))) > 3


def test_filter_steps_against_every_order(spark):
    """All orders applied one document at a time."""
    rng = random.Random(3)
    word = lambda: rng.choice(["alpha", "Beta", "GAMMA", "delta#", "e"]) + str(rng.randrange(60))
    texts = [" ".join(word() for _ in range(rng.choice([5, 99, 100, 140]))) for _ in range(40)]
    rows = [(i, rng.choice([*texts, None, ""]), rng.choice(["en", "fr", "", None])) for i in range(200)] + [(None, texts[0], "en"), (None, texts[0], "fr"), (3, texts[1], "en"), (3, texts[1], "en")]
    labels = [(i, rng.randrange(2), rng.randrange(2)) for i in range(150)] + [(5, 1, 1), (None, 1, 1)]
    audited = filter_audit.audit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {(r["part"], r["filter_order"], r["step"]): r for r in audited.collect()}
    good, toxic = ({k for k, *marks in labels if marks[j] == 1 and k is not None} for j in range(2))

    def fails(key, text):
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        first = min((k for k, t, _ in rows if (t or "") == text and k is not None), default=None)
        return {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": key is not None and first < key}

    flags = [(part or "", key, fails(key, text)) for key, text, part in rows]
    shapley, want = Counter(), {}
    for part in {p for p, _, _ in flags}:
        own = [(k, f) for p, k, f in flags if p == part]
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                gone, kept = [d for d in left if d[1][x]], [d for d in left if not d[1][x]]
                failing = sum(f[x] for _, f in own)
                want[part, "".join(order), step] = (len(kept), len(gone), failing - len(gone), sum(f[x] and sum(f.values()) == 1 for _, f in own), sum(k in good for k, _ in gone), sum(k in toxic for k, _ in gone))
                shapley[part, x] += len(gone)
                left = kept
    assert got.keys() == want.keys()
    for key, r in got.items():
        assert tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")) == want[key]
        assert r["shapley"] == shapley[key[0], key[1][key[2] - 1]]


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_near_words_lose_no_pair(spark):
    """Every pair at one edit, over words of few letters, repeated bigrams and all places of the edit."""
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randrange(5, 9))) for _ in range(700)} | {"aaaaa", "aaaaaa", "aaaaaaa", "ababab", "bababa", "abababa"})
    df = spark.createDataFrame([(w, 3 + i % 7) for i, w in enumerate(words)], "word string, n long")
    got = [tuple(sorted((r["a"], r["b"]))) for r in spelling.near_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a, b in itertools.combinations(words, 2) if one_edit(a, b)}


def test_forms_and_roots(spark):
    """Counts, ties, chains of forms and words below the least count or length."""
    counts = {"abcde": 40, "abcdx": 20, "abcxx": 10, "abxxx": 5, "axxxx": 4, "wwwww": 3, "wwwwa": 6, "wwwwb": 6, "zzzzz": 2, "zzzzy": 9, "four": 50, "Éabcd": 3, "éabcd": 7}
    free = {w: next(i for i in itertools.count(100 * k) if zlib.crc32(f"{i}:{w}".encode()) % 97) for k, w in enumerate(counts)}
    rows = [(free[w], " ".join([w] * n)) for w, n in counts.items()]
    got = {r["word"]: tuple(r)[1:] for r in spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {
        "abcde": (None, "abcde", 40, 1, None), "abcdx": ("abcde", "abcde", 20, 2, 40), "abcxx": ("abcdx", "abcde", 10, 2, 20), "abxxx": ("abcxx", "abcde", 5, 2, 10), "axxxx": (None, "axxxx", 4, 1, None),
        "wwwww": ("wwwwa", "wwwwa", 3, 2, 6), "wwwwa": (None, "wwwwa", 6, 2, None), "wwwwb": (None, "wwwwb", 6, 2, None), "zzzzy": (None, "zzzzy", 9, 0, None), "Éabcd": ("éabcd", "éabcd", 3, 1, 7), "éabcd": (None, "éabcd", 7, 1, None),
    }


def test_misprints_follow_the_digest(spark):
    """A run whose digest 97 divides loses the code point that the digest names; only A to Z are lower-cased."""
    key = next(i for i in range(10_000) if zlib.crc32(f"{i}:straße".encode()) % 97 == 0)
    at = zlib.crc32(f"{key}:straße".encode()) % 6
    rows = spark.createDataFrame([(key, "Straße STRAßE straße 1straße_"), (None, None)], "doc_id long, text string")
    assert {r["word"]: r["n"] for r in spelling.word_counts(rows).collect()} == {"straße"[:at] + "straße"[at + 1 :]: 4}
