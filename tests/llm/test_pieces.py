import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceNormalizer, SentencePieceProcessor

from jobgrain.llm import pieces, queries

PATH = public_tokenizers.path("piece_bpe_32k.model")


def with_rules(name, **flags):
    """The model file with other rules for normalising: a compiled map of the library's, and flags by field number."""
    with open(PATH, "rb") as f:
        parts = [(n, v, whole) for n, v, whole in pieces.fields(f.read())]
    if name is None:
        return b"".join(w for _, _, w in parts)
    spec = b"".join(w for n, _, w in pieces.fields(SentencePieceNormalizer(rule_name=name).serialized_normalizer_spec()) if n <= 2)
    spec += b"".join(bytes([n << 3, int(v)]) for n, v in ((3, flags.get("prefix", 1)), (4, flags.get("trim", 1)), (5, 1)))
    size = len(spec)
    head = b"\x1a"
    while size > 127:
        head, size = head + bytes([size & 127 | 128]), size >> 7
    return b"".join(w for n, _, w in parts if n != 3) + head + bytes([size]) + spec


def odd_texts(n=1500):
    rng = random.Random(3)
    alphabet = "ab cd  e▁\n\t\r;)}é日本語😀\x00\x7f  x①㍿ｶﾞ가́　 ​\xa0ﬁA"
    return ["", " ", "  ", "a", "▁", " ▁ a", "a ▁b", "tail  ", "\n\n a"] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def encoded(model, texts):
    ids, spans, counts = model.encode([t.encode() for t in texts])
    cut = np.r_[0, np.cumsum(counts)]
    return [(ids[a:b].tolist(), list(zip(*spans[:, a:b].tolist(), strict=True))) for a, b in zip(cut[:-1], cut[1:], strict=True)]


@pytest.mark.parametrize("name,flags", [(None, {}), ("nmt_nfkc", {}), ("nfkc", {"trim": 0}), ("nmt_nfkc_cf", {"prefix": 0})])
def test_ids_and_spans_are_the_librarys(spark, sf, name, flags):
    data = with_rules(name, **flags)
    plain, own = SentencePieceProcessor(model_proto=data), pieces.Pieces(data)
    assert own.by_segment == (name is None)
    texts = odd_texts() + [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").limit(200 if name is None else 20).collect()]
    got = encoded(own, texts)
    want = [[(p.id, (p.begin, p.end)) for p in x.pieces] for x in (plain.encode(t, return_type="proto") for t in texts)]
    assert got == [([i for i, _ in w], [s for _, s in w]) for w in want]
    assert encoded(own, texts) == got  # remembered
    own.held = pieces.REMEMBERED + 1
    assert encoded(own, texts[-5:]) == got[-5:]  # and forgotten
    flat = [i for ids, _ in got for i in ids]
    assert own.decode(np.array(flat, np.int32), np.r_[0, np.cumsum([len(ids) for ids, _ in got])]) == [plain.decode(ids) for ids, _ in got]


@pytest.mark.parametrize("name,flags", [(None, {}), ("nmt_nfkc", {}), ("nfkc", {"prefix": 0, "trim": 0})])
def test_any_ids_decode_as_in_the_library(name, flags):
    data = with_rules(name, **flags)
    plain, own = SentencePieceProcessor(model_proto=data), pieces.Pieces(data)
    rng = random.Random(6)
    rows = [[rng.randrange(32000) if rng.random() < 0.5 else rng.choice([0, 1, 2, 28705, 259, *range(3, 259)]) for _ in range(rng.randint(0, 12))] for _ in range(4000)]
    got = own.decode(np.array([i for r in rows for i in r], np.int32), np.r_[0, np.cumsum([len(r) for r in rows])])
    assert got == [plain.decode(r) for r in rows]


def test_malformed_bytes():
    own = pieces.Pieces(with_rules(None))
    plain = SentencePieceProcessor(model_proto=with_rules(None))
    for t in (b"a\xff b\xe4\xb8 c", b"\xf0\x9f", b"ok \xc3( \xe2\x96\x81"):
        ids, spans, counts = own.encode([t])
        want = plain.encode(t, return_type="proto").pieces
        assert (ids.tolist(), list(zip(*spans.tolist(), strict=True))) == ([p.id for p in want], [(p.begin, p.end) for p in want])


def test_query_on_odd_rows(spark, tmp_path):
    plain = SentencePieceProcessor(model_file=PATH)
    rows = [(i, t) for i, t in enumerate(odd_texts(200))] + [(None, None), (None, "x y"), (7, None), (7, "same  text "), (7, "same  text "), (2**60, "long words " * 20_000), (5, "x" * 50_000 + "é" * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"ids": F.lit(1), "id": F.lit("x"), "decoded": F.lit(2)})
    df.write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in rows:
        ids = plain.encode(t or "")
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(plain.decode(ids)), len((t or "").encode())))
    got = queries.op13_piece_spans(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert not pieces.encode_pieces(df.limit(0), PATH).count()
    none = spark.createDataFrame([(1, None), (2, [])], "k int, ids array<int>")
    assert [tuple(r) for r in pieces.decode_pieces(none, PATH).orderBy("k").select("k", "decoded").collect()] == [(1, ""), (2, "")]
    with pytest.raises(ValueError, match="already"):
        pieces.decode_pieces(none.withColumn("decoded", F.lit(1)), PATH)
