import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from quillon.llm import piece_bpe


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=piece_bpe.default_model())


@pytest.fixture(scope="module")
def model():
    return piece_bpe.Model(piece_bpe.default_model())


def compare(model, library, texts):
    ids, first = model.encode(pa.array(texts, pa.string()))
    want = [library.encode(x or "", num_threads=1) for x in texts]
    assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == want
    assert model.decode(ids, first).to_pylist() == [library.decode(w) for w in want]


def test_encode_equals_the_library(model, library):
    r = random.Random(13)
    odd = ["▁", " ", "a", "b", "e", "h", "in", "er", " the", "  ", "ing", "0", "1", ".", "é", "ß", "你好", "на", "😀", "\n", "\t", "==", "--", "ab", "aa", "<s>", "</s>", "<0x41>", "́", "ქ", "\0"]
    pieces = [library.id_to_piece(i) for i in range(259, library.vocab_size())]
    texts = ["", None, " ", "\n", "▁x", "a" * 5_000, " " * 777, "=" * 333]
    texts += ["".join(r.choices(odd, k=r.randint(1, 50))) for _ in range(3000)]
    texts += ["".join(r.choices(pieces, k=r.randint(1, 30))) for _ in range(1500)]
    texts += ["".join(r.choices("aeinrst", k=r.randint(1, 200))) for _ in range(500)]  # words in which merges compete
    texts += ["".join(chr(r.choice([r.randint(1, 0x2FF), r.randint(0x300, 0xD7FF), r.randint(0xE000, 0x1FFFF)])) for _ in range(60)) for _ in range(300)]
    compare(model, library, texts)


def test_merges_wait_for_sooner_ones():
    """With pieces that an early merge makes possible, the rounds merge in the library's order."""
    m = object.__new__(piece_bpe.Model)
    names = ["a", "b", "c", "ab", "abc", "ca", "abca"]
    ids = {x: i for i, x in enumerate(names)}
    r = random.Random(5)
    for _ in range(300):
        rank = dict(zip(names[3:], r.sample(range(4), 4), strict=True))
        splits = [(x[:k], x[k:], x) for x in names[3:] for k in range(1, len(x)) if x[:k] in ids and x[k:] in ids]
        m.n = m.base = len(names)
        m.merged, m.ranks = np.array([ids[x] for *_, x in splits]), np.array([rank[x] for *_, x in splits] + [piece_bpe.NONE], np.int32)
        m.pairs = piece_bpe.Table(np.array([ids[a] * m.base + ids[b] for a, b, _ in splits]), np.arange(len(splits)))
        words = ["".join(r.choices("abc", k=r.randint(1, 14))) for _ in range(20)]
        got, first = m.merge(np.array([ids[c] for w in words for c in w]), np.concatenate([[0], np.cumsum([len(w) for w in words])]))
        for w, a, b in zip(words, first[:-1], first[1:], strict=True):
            now = list(w)
            while pairs := [(rank[x + y], i) for i, (x, y) in enumerate(zip(now, now[1:], strict=False)) if x + y in rank]:
                _, i = min(pairs)
                now[i : i + 2] = [now[i] + now[i + 1]]
            assert [names[s] for s in got[a:b]] == now, (w, rank)


def test_decode_equals_the_library(model, library):
    r = random.Random(2)
    rows = [[r.choice([r.randrange(3, 259), r.randrange(259, library.vocab_size()), 259, 2]) for _ in range(r.randint(0, 12))] for _ in range(3000)]
    first = np.concatenate([[0], np.cumsum([len(x) for x in rows])])
    got = model.decode(np.array([i for x in rows for i in x]), first).to_pylist()
    apart = lambda x: not any(a < 259 and b < 3 for a, b in zip(x, x[1:], strict=False))  # noqa: E731  bytes before a control id
    assert [g for g, x in zip(got, rows, strict=True) if apart(x)] == [library.decode(x) for x in rows if apart(x)]
    with pytest.raises(ValueError):
        model.decode(np.array([library.vocab_size()]), np.array([0, 1]))


def test_bytes_that_are_not_utf8(model):
    raw = pa.array([b"a\xe2\x82z", b"ok"]).view(pa.string())
    ids, first = model.encode(raw)
    assert model.decode(ids, first).to_pylist() == ["a��z", "ok"]


def test_other_models_are_refused(tmp_path):
    with open(piece_bpe.default_model(), "rb") as f:
        raw = f.read()
    p = tmp_path / "m.model"
    p.write_bytes(raw.replace(b"\x18\x02 \x80\xfa\x01", b"\x18\x01 \x80\xfa\x01"))  # another kind of model
    with pytest.raises(ValueError):
        piece_bpe.Model(str(p))


def test_operator_and_query(spark, sf, docs, odd, library):
    got = piece_bpe.encode(docs(odd)).collect()
    key = lambda x: repr(x)
    assert sorted(((r.doc_id, r.ids) for r in got), key=key) == sorted(((i, library.encode(t or "", num_threads=1)) for i, t in odd), key=key)
    back = piece_bpe.decode(spark.createDataFrame(got).unionByName(spark.createDataFrame([(77, None)], "doc_id long, ids array<int>"))).collect()
    assert sorted((r.doc_id, r.text) for r in back if r.doc_id and r.doc_id != 77) == sorted((i, t or "") for i, t in odd if i)
    assert [r.text for r in back if r.doc_id == 77] == [""]
    assert piece_bpe.encode(docs([])).collect() == []
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = piece_bpe.query(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id] or "", num_threads=1)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))
