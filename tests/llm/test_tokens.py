import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from jobgrain.llm import packing, token_files
from jobgrain.llm.dac import Codes, pack
from jobgrain.llm.tokens import WordTokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [(3, None), (9, ""), (5, " \n "), (5, "Don'T <|endoftext|> <|EndOfText|>x Don'T"), (7, "H̱ É ́a x\x1fy z q ΑΣ. It's'S"), (1, "lorem Ipsum, dolor! " * 3000)]


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


def test_words_encode_as_whole_texts(plain, spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()] + [t or "" for _, t in ODD]
    got = WordTokenizer(PATH).encode([t.encode() for t in texts])
    assert [x.tolist() for x in got] == [x.ids for x in plain.encode_batch(texts, add_special_tokens=False)]


def test_marks_and_tokenizers_that_keep_white_space(plain):
    texts = ["a\x01b \x01 \x01\x01 c\x01", "<|endoftext|>\x01 x", "", " ", "क़ İİ Kelvin \u212a \u00a0z"]
    got = WordTokenizer(PATH).encode([t.encode() for t in texts])
    assert [x.tolist() for x in got] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = WordTokenizer(path)
    assert not whole.by_word
    assert [x.tolist() for x in whole.encode([t.encode() for t in texts])] == [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in texts]


def test_few_remembered_words(plain):
    some = WordTokenizer(PATH)
    some.remembered = 3
    for t in ("one two three four five", "six five Four, one"):
        assert [x.tolist() for x in some.encode([t.encode(), t.encode()])] == [plain.encode(t, add_special_tokens=False).ids] * 2


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 4000])
def test_codes(n):
    rng = np.random.default_rng(n)
    ids = (rng.integers(0, 2**32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
    code = Codes(pack(ids))
    assert len(code) == n
    assert [code[i] for i in range(n)] == ids.tolist()
    for _ in range(30):
        a, b = sorted(rng.integers(0, n + 1, 2).tolist())
        assert code.slice(a, b).tolist() == ids[a:b].tolist()
    with pytest.raises(IndexError):
        code[n]


def expected(plain, rows, end):
    return [(i, np.array([*plain.encode(t or "", add_special_tokens=False).ids, end], "<u4")) for i, t in rows]


def test_files_round_trip(plain, spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENT", 5000)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, part string")
    path = str(tmp_path / "ids")
    token_files.write_ids(docs, path, PATH, 2)
    got = {r.doc_id: r for r in token_files.read_documents(spark, path).collect()}
    start, every = 0, []
    for i, ids in sorted(expected(plain, rows, 2), key=lambda x: x[0]):
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
        every += ids.tolist()
    assert len(got) == len(rows)
    places = [0, 1, 255, 4999, 5000, len(every) - 1, 77_777 % len(every)]
    asked = spark.createDataFrame([(p,) for p in [*places, len(every), -1, None]], "position long")
    assert {r.position: r.token for r in token_files.tokens_at(asked, path).collect()} == {p: every[p] for p in places}


def test_files_of_odd_rows(plain, spark, tmp_path):
    docs = spark.createDataFrame([*ODD, (None, "a b")], "doc_id long, text string")
    token_files.write_ids(docs, str(tmp_path / "odd"), PATH, 2)
    got = sorted((r.start, r.n_tokens, r.ids_crc32) for r in token_files.read_documents(spark, str(tmp_path / "odd")).collect())
    assert sorted(x[1:] for x in got) == sorted((len(x), zlib.crc32(x.tobytes())) for _, x in expected(plain, [*ODD, (None, "a b")], 2))
    assert all(a[0] + a[1] == b[0] for a, b in zip(got, got[1:]))
    token_files.write_ids(docs.where("doc_id < 0"), str(tmp_path / "none"), PATH, 2)
    assert token_files.read_documents(spark, str(tmp_path / "none")).count() == 0


def test_files_of_string_ids_and_one_hot_id(plain, spark, tmp_path):
    rows = [("b", "one two")] * 300 + [(None, "x")] * 300 + [("a", "y z")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    token_files.write_ids(docs, str(tmp_path / "hot"), PATH, 2)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in token_files.read_documents(spark, str(tmp_path / "hot")).collect())
    assert [(i, n) for _, i, n in got] == [(None, 2)] * 300 + [("a", 3)] + [("b", 3)] * 300
    assert spark.read.parquet(str(tmp_path / "hot")).select("part").distinct().count() > 2


def check_packed(plain, rows, packed, capacity):
    want = sorted((i if i is not None else -1, p, p * capacity, len(x[p * capacity : (p + 1) * capacity]), zlib.crc32(x[p * capacity : (p + 1) * capacity].tobytes())) for i, x in expected(plain, rows, 0) for p in range(-(-len(x) // capacity)))
    assert sorted((r.id if r.id is not None else -1, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == want
    by = {}
    for r in packed:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in by.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by), -(-sum(w[3] for w in want) // capacity)


def test_packing(plain, spark, sf, monkeypatch):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + ODD + ODD[-1:] * 5 + [(None, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for together in (50_000, 3):
        monkeypatch.setattr(packing, "RANKED_TOGETHER", together)
        used, least = check_packed(plain, rows, packing.pack_documents(docs, PATH, 0).collect(), 2048)
        assert used <= least * 1.02 + 1
    assert packing.pack_documents(docs.where("doc_id < 0"), PATH, 0).count() == 0


def best_fit_one_by_one(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits, key=rooms.__getitem__)] -= n
        else:
            rooms.append(capacity - n)
    return len(rooms)


@pytest.mark.parametrize("mean, spread, n", [(6.6, 0.9, 3000), (7.0, 0.3, 2000), (7.0, 0.4, 3000), (6.5, 0.06, 3000), (3.0, 0.1, 500)])
def test_plan_holds_every_length_and_never_loses_to_best_fit(mean, spread, n):
    rng = np.random.default_rng(0)
    lengths = np.minimum(2048, np.exp(rng.normal(mean, spread, n)).astype(int) + 1)
    histogram = {int(n): int(k) for n, k in zip(*np.unique(lengths, return_counts=True), strict=True)}
    plan, held = packing.plan_packing(histogram, 2048), {}
    for config, times in plan:
        assert sum(a * k for a, k in config.items()) <= 2048
        for a, k in config.items():
            held[a] = held.get(a, 0) + k * times
    assert held == histogram
    plain = best_fit_one_by_one(lengths.tolist(), 2048)
    assert sum(t for _, t in packing.best_fit(histogram, 2048)) == plain
    assert -(-int(lengths.sum()) // 2048) <= sum(t for _, t in plan) <= plain


@pytest.mark.parametrize("each", [10, 1000])
def test_whole_configurations_hold_nine_pieces_in_ten(each):
    lengths = np.minimum(2047, np.exp(np.random.default_rng(3).normal(6.2, 1.0, 8000)).astype(int) + 1)
    histogram = {int(n): int(k) * each for n, k in zip(*np.unique(lengths, return_counts=True), strict=True)}
    whole, left = packing.configuration_program(histogram, 2048)
    held = dict(left)
    for config, times in whole:
        assert times > 0 and sum(n * k for n, k in config.items()) <= 2048
        for n, k in config.items():
            held[n] = held.get(n, 0) + k * times
    assert held == histogram
    assert sum(left.values()) <= 0.1 * sum(histogram.values())
    used = lambda plan: sum(t for _, t in plan)
    assert used(packing.best_fit(left, 2048, whole)) <= used(packing.best_fit(histogram, 2048))


def test_configuration_program_beats_best_fit():
    lengths = np.random.default_rng(0).integers(600, 760, 100_000)
    histogram = {int(n): int(k) for n, k in zip(*np.unique(lengths, return_counts=True), strict=True)}
    assert sum(t for _, t in packing.plan_packing(histogram, 2048)) < 0.95 * sum(t for _, t in packing.best_fit(histogram, 2048))
