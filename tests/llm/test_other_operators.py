import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.llm import chat_format, decontaminate, embedding_dedup, mixing, quality, token_files


# -- token files -----------------------------------------------------------------------------------


def test_encoder_equals_whole_texts():
    from tokenizers import Tokenizer

    path = token_files.default_tokenizer()
    t = Tokenizer.from_file(path)
    r = random.Random(3)
    alphabet = "abcXYZ019 .,;:!?'\"<|>-_\n\t éÈßΣςİ中🙂́"
    texts = ["".join(r.choice(alphabet) for _ in range(60)) for _ in range(400)] + ["", None, "it's we'll.", "<|endoftext|>.", "a<|startoftext|> B.", "word.</w>", "<|ENDOFTEXT|>"]
    ids, n = token_files.Encoder(path).encode(pa.array(texts))
    end = np.cumsum(n)
    for x, a, b in zip(texts, end - n, end, strict=True):
        assert ids[a:b].tolist() == t.encode(x or "", add_special_tokens=False).ids, x


@pytest.mark.parametrize("n", [0, 1, 2, 255, 256, 257, 3000])
@pytest.mark.parametrize("universe", [1, 100, 10**6, 10**13])
def test_elias_fano(n, universe):
    v = np.sort(np.random.default_rng(n).integers(0, universe, n))
    ef, used = token_files.EliasFano.from_buffer(np.frombuffer(token_files.EliasFano.encode(v).to_bytes() + b"xx", np.uint8))
    assert (ef.select_range(0, n) == v).all() and all((ef.select_range(a, b) == v[a:b]).all() for a, b in ((0, n // 3), (n // 3, n), (n // 2, min(n, n // 2 + 300)), (n, n)))
    assert all(ef.select(i) == v[i] for i in range(0, n, max(1, n // 40)))
    if n >= 3000 and universe == 10**6:
        assert used * 8 / n < 2.5 + math.log2(universe / n) + 1
    with pytest.raises(IndexError):
        ef.select(n)


def test_files_round_trip(spark, docs, odd, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_files.default_tokenizer())
    manifest = token_files.write_files(docs(odd), f"file://{tmp_path}/t", shards=3)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.read_files(spark, manifest).collect())
    assert [d for _, d, _, _ in got] == sorted((i for i, _ in odd), key=lambda i: (i is not None, i or 0))
    at = 0
    ids_of = lambda x: t.encode(x or "", add_special_tokens=False).ids + [1]
    for start, d, n, crc in got:
        assert start == at
        at += n
        assert (n, crc) in [(len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for i in (ids_of(x) for j, x in odd if j == d)]
    first = token_files.TokenFile(min(manifest.collect()).path)
    assert sum(len(first.ids(i)) for i in range(first.n_docs)) == first.n_ids
    assert token_files.run(docs([]), f"file://{tmp_path}/e").collect() == []


# -- mixing ----------------------------------------------------------------------------------------


def water_fill(sizes):
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = [s for s in names if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        share = {s: left * w[s] / sum(w[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] >= 3 * sizes[s]]
        if not over:
            return {s: float(3 * sizes[s]) if s in capped else share[s] for s in names}
        capped |= set(over)


def test_mixing(docs, prose):
    r = random.Random(5)
    rows = [(i, " ".join(prose(i, r.randrange(20, 60))), r.choice(["a", "b", "B", "c", "d", None, "é"] + ["hot"] * 7)) for i in range(3000)]
    got = mixing.plan(docs(rows)).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want, taken, variance = water_fill(sizes), {}, {}
    for x in got:
        assert x.source_size == sizes[x.source] and math.isclose(x.target, want[x.source], rel_tol=1e-12)
        rate = x.target / x.source_size
        assert x.copies in (math.floor(rate), math.ceil(rate)) and x.copies <= 3
        taken[x.source] = taken.get(x.source, 0) + x.size * x.copies
        variance[x.source] = variance.get(x.source, 0) + x.size**2 * (rate % 1) * (1 - rate % 1)
    assert all(abs(taken[s] - want[s]) <= 4 * variance[s] ** 0.5 for s in sizes)
    mixed = mixing.mix(docs(rows))
    assert mixed.columns == docs([]).columns
    assert sorted(x.doc_id for x in mixed.collect()) == sorted(x.doc_id for x in got for _ in range(x.copies))


def test_mixing_large_number_of_sources_takes_the_other_join(docs, monkeypatch):
    rows = [(i, "a b c", f"s{i % 5}") for i in range(40)]
    want = sorted((r.doc_id, r.copies) for r in mixing.plan(docs(rows)).collect())
    monkeypatch.setattr(mixing, "MAX_BROADCAST", 0)
    assert sorted((r.doc_id, r.copies) for r in mixing.plan(docs(rows)).collect()) == want


def test_mixing_odd(docs, odd):
    assert len(mixing.plan(docs(odd)).collect()) == len(odd) and mixing.plan(docs([])).collect() == [] and mixing.mix(docs([])).collect() == []
    assert [r.copies for r in mixing.plan(docs([(1, None, "a"), (2, "", None)])).collect()] == [0, 0]


# -- quality ---------------------------------------------------------------------------------------


def test_quality_learns_held_out_rows(spark, docs, prose):
    rows, labels = [], []
    for i in range(300):
        w = prose(i, 60 + i % 300)
        bad = i % 4 == 0
        if bad:  # junk in one part of the text only
            w[30:60] = [x.upper() + "!!" for x in w[30:60]] if i % 8 else [w[0] + "###"] * 30
        rows.append((i, " ".join(w)))
        labels.append((i, int(not bad), 0))
    d, l = docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.train(d, l)
    got = quality.score(d, model).withColumn("held_out", quality.held_out()).collect()
    test = [r for r in got if r.held_out]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 3 == 1) == r.held_out for r in got) and 70 < len(test) < 130
    assert sum((r.score >= 0.5) == (r.doc_id % 4 != 0) for r in test) / len(test) > 0.95
    kept = quality.keep_good(d, model)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.score >= 0.5}


def test_attention_finds_the_passage():
    r = np.random.default_rng(0)
    x, y, first = [], [], [0]
    for i in range(300):
        bag = r.normal(0, 1, (r.integers(3, 9), quality.N_FEATURES)).astype(np.float32)
        y.append(i % 2)
        if not y[-1]:
            bag[r.integers(len(bag)), :4] += 3
        x.append(bag)
        first.append(first[-1] + len(bag))
    first = np.array(first)
    m = quality.fit(np.concatenate(x[:200]), first[:201], np.array(y[:200]))
    got = m.score(np.concatenate(x[200:]), first[200:] - first[200])
    assert ((got >= 0.5) == np.array(y[200:])).mean() > 0.85


def test_quality_odd(spark, docs, odd):
    none = spark.createDataFrame([], "doc_id long, quality int")
    m = quality.train(docs(odd), none)
    assert {r.score for r in quality.score(docs(odd), m).collect()} == {0.5}
    some = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (4, 0), (6, 1), (6, 0)], "doc_id long, quality int")
    got = quality.score(docs(odd), quality.train(docs(odd), some)).collect()
    assert len(got) == len(odd) and all(0 <= r.score <= 1 for r in got)
    assert quality.score(docs([]), m).collect() == [] and quality.keep_good(docs([]), m).collect() == []


# -- decontamination -------------------------------------------------------------------------------


@pytest.fixture
def items(spark, prose):
    rows = [(i, " ".join(prose(900 + i, 25 + i))) for i in range(8)] + [(50, None), (51, "too short"), (None, " ".join(prose(950, 20)))]
    return spark.createDataFrame(rows, "item_id long, text string")


def test_exact_and_edited_items_are_found(docs, items, prose):
    text = {r.item_id: r.text.split() for r in items.collect() if r.text}
    sub = [w if i % 5 else "changed" for i, w in enumerate(text[3])]
    gone = [w for i, w in enumerate(text[4]) if i % 6 != 2]
    more = [x for i, w in enumerate(text[5]) for x in ([w, "added"] if i % 6 == 1 else [w])]
    rows = [(10 + k, " ".join(prose(k, 200) + part + prose(k + 40, 3000))) for k, part in enumerate((text[0], sub, gone, more, text[6][:8], []))]
    rows += [(100 + i, " ".join(prose(300 + i, 20) + text[7] + prose(400 + i, 20))) for i in range(60)]  # a passage most documents have
    rows += [(200, " ".join(text[3] + text[4])), (201, " ".join(w if i % 4 else "else" for i, w in enumerate(text[7])))]
    got = {(r.doc_id, r.item_id): r for r in decontaminate.find(docs(rows), items).collect()}
    assert set(got) == {(10, 0), (11, 3), (12, 4), (13, 5), (200, 3), (200, 4), (201, 7)} | {(100 + i, 7) for i in range(60)}
    assert got[10, 0].score == 1 and (got[10, 0].first_word, got[10, 0].end_word) == (200, 225)
    clean = decontaminate.clean(docs(rows), items)
    assert clean.columns == docs([]).columns and sorted(r.doc_id for r in clean.collect()) == [14, 15]


def test_blocks_of_items_make_no_difference(docs, items, prose, monkeypatch):
    rows = [(i, " ".join(prose(900 + i % 8, 25 + i % 8))) for i in range(16)]
    want = sorted((r.doc_id, r.item_id) for r in decontaminate.find(docs(rows), items).collect())
    monkeypatch.setattr(decontaminate.blocks, "__defaults__", (3, 60))
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.find(docs(rows), items).collect()) == want and len(want) == 16
    assert decontaminate.clean(docs(rows), items).collect() == []


def test_alignment_against_brute_force():
    r = np.random.default_rng(2)
    for _ in range(25):
        a, b = r.integers(2, 8, 14).astype(np.uint64), r.integers(2, 8, 40).astype(np.uint64)
        row, best = [0] * 41, 0
        for x in a:
            new = [0]
            for j, y in enumerate(b, 1):
                new.append(max(0, row[j - 1] + (2 if x == y else -1), row[j] - 1, new[j - 1] - 1))
            row, best = new, max(best, max(new))
        score, first, end = decontaminate.align([a, a[:3]], [b, b[:5]])
        assert score[0] == best and first[0] < end[0]


def test_decontamination_odd(spark, docs, odd, items):
    assert decontaminate.find(docs(odd), items).collect() == [] and decontaminate.clean(docs(odd), items).count() == len(odd)
    assert decontaminate.find(docs([]), items).collect() == []
    assert decontaminate.find(docs(odd), items.where("false")).collect() == [] and decontaminate.clean(docs(odd), items.where("false")).count() == len(odd)


# -- embeddings ------------------------------------------------------------------------------------


def brute_links(rows):
    ok = [(i, l, np.array(v, float)) for i, l, v in rows if i is not None and l is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    links = {id(r): 0 for r in ok}
    root = {i: i for i, _, _ in ok}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for p in range(len(ok)):
        for q in range(p + 1, len(ok)):
            (i, l, a), (j, m, b) = ok[p], ok[q]
            if l == m and len(a) == len(b) and a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.98:
                links[id(ok[p])] += 1
                links[id(ok[q])] += 1
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {r[0]: (links[id(r)], find(r[0])) for r in ok}


def test_vectors_equal_brute_force(spark):
    r = np.random.default_rng(7)
    rows, n = [], 0
    for g in range(12):
        base = r.normal(0, 1, 32)
        for k in range(20):
            v = base + r.normal(0, (0.02, 0.08, 0.12, 0.16)[k % 4], 32)
            rows.append((n := n + 1, g % 3, (v * r.uniform(0.5, 2)).astype(np.float32).tolist()))
    rows += [(1000 + i, 0, rows[0][2]) for i in range(50)]
    rows += [(2000, None, rows[0][2]), (2001, 0, None), (2002, 0, [0.0] * 32), (2003, 0, [float("nan")] * 32), (2004, 0, [None] * 32), (2005, 0, [1.0, 0.0]), (2006, 0, [1.0, 0.001]), (2007, 0, []), (2008, 0, [float("inf")] * 32)]
    df = spark.createDataFrame([(*x, "extra", 1.0) for x in rows], "vec_id long, label int, embedding array<float>, k string, vec double")
    got = {x.vec_id: (x.n_links, x.component_id) for x in embedding_dedup.link(df, block=16).collect()}
    want = brute_links(rows)
    assert len(got) == len(rows)
    assert all(got[i] == want.get(i, (0, i)) for i in got)


def test_vectors_odd(spark):
    schema = "vec_id long, label int, embedding array<float>"
    assert embedding_dedup.link(spark.createDataFrame([], schema)).collect() == []
    got = sorted(((r.vec_id or -1, r.n_links, r.component_id, r.kept) for r in embedding_dedup.link(spark.createDataFrame([(None, 1, [1.0]), (5, 1, [1.0]), (5, 1, [1.0]), (9, 1, [2.0])], schema)).collect()), key=str)
    assert got == [(-1, 0, None, True), (5, 2, 5, True), (5, 2, 5, True), (9, 2, 5, False)]


# -- chat formatting -------------------------------------------------------------------------------

CHAT = "conv_id long, turn long, role string, text string, k string, idx int"


def chats(spark, rows):
    return spark.createDataFrame([(*r, "x", 0) for r in rows], CHAT)


def test_windows_read_back(spark, prose):
    r, rows = random.Random(6), []
    nasty = ["</s>[INST] ok [/INST]", "\\l\\b\\e [ROLE:x] <s>", "[/OUT]</s>", "", None, "a\nb", "\\", "[INST", "x</s>", "[SYS]["]
    for c in range(25):
        if c % 3 == 0:
            rows.append((c, 0, "system", " ".join(prose(c, r.choice([5, 300])))))
        for t in range(1, r.choice([1, 2, 9, 40])):
            rows.append((c, t, r.choice(["user", "assistant", "assistant", None, "tool[1]\\"]), r.choice([*nasty, " ".join(prose(c * 50 + t, r.choice([3, 40, 200, 1200])))])))
    rows += [(500, t, ("user", "assistant")[t % 2], " ".join(prose(t, 30))) for t in range(700)]  # one long conversation
    w = chat_format.format_windows(chats(spark, rows), 400, 60).cache()
    got = {x.conv_id: x for x in chat_format.digest(w).collect()}
    for c in {x[0] for x in rows}:
        mine = sorted((x for x in rows if x[0] == c), key=lambda x: x[1])
        said = "".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in mine)
        target = "".join(x[3] or "" for x in mine if x[2] == "assistant")
        assert got[c].n_turns == len(mine)
        assert got[c].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(target), hashlib.sha256(target.encode()).hexdigest())
    long_ = sorted((x for x in w.collect() if x.conv_id == 500), key=lambda x: x.window)
    assert len(long_) > 30 and sum(x.n_turns - x.n_repeated for x in long_) == 700 and all(x.n_repeated > 0 for x in long_[1:]) and long_[0].n_repeated == 0
    assert all(len(x.formatted.split()) <= 400 + 4 for x in long_)
    system = [x for x in w.collect() if x.conv_id == 0]
    assert all(x.formatted.startswith("<s>[SYS] ") for x in system)


def test_repeated_targets_are_masked(spark, prose):
    w = chat_format.format_windows(chats(spark, [(1, t, ("user", "assistant")[t % 2], f"w{t} " * 20) for t in range(40)]), 200, 50).collect()
    spans = [x.formatted[s.start : s.start + s.length] for x in w for s in x.loss]
    assert sorted(spans) == sorted(f"w{t} " * 20 for t in range(1, 40, 2))


def test_chat_odd(spark):
    assert chat_format.digest(chat_format.format_windows(chats(spark, []))).collect() == []
    rows = [(None, 1, "user", "a"), (None, None, "assistant", "b"), (1, 1, "user", "x"), (1, 1, "user", "x"), (1, 1, "assistant", "a"), (2, 0, "system", "alone")]
    got = {r.conv_id: r for r in chat_format.digest(chat_format.format_windows(chats(spark, rows))).collect()}
    assert got[None].turns_sha256 == hashlib.sha256(b"assistant\nb\nuser\na\n").hexdigest()
    assert got[1].n_turns == 3 and got[1].turns_sha256 == hashlib.sha256(b"assistant\na\nuser\nx\nuser\nx\n").hexdigest()
    assert got[2].n_turns == 1 and got[2].loss_chars == 0
    with pytest.raises(ValueError):
        chat_format.format_windows(chats(spark, rows), 100, 60)


def test_queries_with_sql_equal_it(spark, sf, duck):
    from quillon.llm import registry

    for name, sql in registry.ORACLE_SQL.items():
        got, want = registry.QUERIES[name](spark, sf).toPandas(), duck.execute(sql).fetchdf()
        cols = sorted(want.columns)
        assert sorted(got.columns) == cols
        rows = lambda f: sorted(tuple(map(str, x)) for x in f[cols].itertuples(index=False))
        assert rows(got) == rows(want), name


def test_source_hash_is_of_the_query_columns(spark):
    assert spark.range(1).select(F.md5(F.lit("mix-1:7")).alias("x")).first().x == hashlib.md5(b"mix-1:7").hexdigest()


def test_forward_pass_and_gradient_against_plain_python():
    """Each document by loops over its passages, and each parameter's slope by differences."""
    r = np.random.default_rng(3)
    sizes = [1, 4, 2, 7]
    first = np.concatenate([[0], np.cumsum(sizes)])
    x, y = r.normal(0, 1, (first[-1], 6)), np.array([1.0, 0.0, 0.0, 1.0])
    p = {"W": r.normal(0, 1, (6, 5)), "b": r.normal(0, 1, 5), "V": r.normal(0, 1, (5, 3)), "U": r.normal(0, 1, (5, 3)), "w": r.normal(0, 1, 3), "c": r.normal(0, 1, 5), "c0": np.array([0.3])}
    model = quality.Model(np.zeros(6), np.ones(6), p)

    def plain():
        out = []
        for i, j in zip(first[:-1], first[1:], strict=True):
            h = [[math.tanh(sum(x[k][a] * p["W"][a][b] for a in range(6)) + p["b"][b]) for b in range(5)] for k in range(i, j)]
            gate = [sum(p["w"][m] * math.tanh(sum(hk[b] * p["V"][b][m] for b in range(5))) / (1 + math.exp(-sum(hk[b] * p["U"][b][m] for b in range(5)))) for m in range(3)) for hk in h]
            e = [math.exp(g) for g in gate]
            z = [sum(e[k] / sum(e) * h[k][b] for k in range(len(h))) for b in range(5)]
            out.append(1 / (1 + math.exp(-(sum(z[b] * p["c"][b] for b in range(5)) + p["c0"][0]))))
        return out

    assert np.allclose(model.score(x, first), plain(), atol=1e-12)
    loss = lambda: -sum(t * math.log(q) + (1 - t) * math.log(1 - q) for t, q in zip(y, plain(), strict=True)) / len(y)
    grad = model.gradient(x, first, y)
    for name, value in p.items():
        flat, got = value.ravel(), grad[name].ravel()
        for k in range(0, len(flat), max(1, len(flat) // 6)):
            old = flat[k]
            flat[k] = old + 1e-5
            up = loss()
            flat[k] = old - 1e-5
            down = loss()
            flat[k] = old
            assert abs((up - down) / 2e-5 - got[k]) < 1e-7, (name, k)


def test_scores_are_of_the_query_columns_features(docs, prose):
    """The features of passages, by plain Python, whatever pieces the bytes are worked on in."""
    from quillon.llm import common

    texts = [" ".join(prose(i, n)) + "\nÜber zwei  Zeilen\n" * (i % 3) for i, n in enumerate((0, 1, 127, 128, 129, 700))]
    w = common.Words(*common.text_buffers(pa.array(texts), lower=False), common._NOT_SPACE)
    for chunk in (10, 10**6):
        old, quality.CHUNK = quality.CHUNK, chunk
        x, first = quality.features(w)
        quality.CHUNK = old
        for i, t in enumerate(texts):
            words = t.split()
            assert first[i + 1] - first[i] == max(1, -(-len(words) // 128))
            assert np.allclose(x[first[i] : first[i + 1], 129 + quality.HASHED], [math.log1p(len(words[k : k + 128])) for k in range(0, max(1, len(words)), 128)])
            assert np.allclose(x[first[i], 129 + quality.HASHED + 3], len(set(words)) / max(1, len(words)))
            size = [len(t.encode())] if first[i + 1] - first[i] == 1 else None
            if size:
                assert np.allclose((x[first[i], :129] ** 2).sum(), 1.0 if size[0] else 0.0, atol=1e-5)
                assert np.allclose(x[first[i], ord("a")] ** 2, t.count("a") / max(1, size[0]), atol=1e-6)


def test_what_is_learned_from_is_bounded_and_fixed(spark, docs, prose):
    rows = [(i, " ".join(prose(i, 200 if i else 40_000))) for i in range(30)] + [(5, "another text of document 5"), (5, None)]
    l = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    chosen = quality._learned_from(docs(rows), l, "quality", 1000, 20).collect()
    known = [i for i in range(30) if zlib.crc32(str(i).encode()) % 3 != 1]
    want, total = set(), 0
    texts = {r.doc_id: r.text for r in quality._learned_from(docs(rows), l, "quality", 1000, 10**6).collect()}
    for i in sorted(known, key=lambda i: hashlib.md5(str(i).encode()).hexdigest()):
        total += max(1, -(-len((texts[i] or "").split()) // 128))
        if total <= 20:
            want.add(i)
    assert {r.doc_id for r in chosen} == want and 3 < len(want) < 15 and set(texts) == set(known)


def test_short_items_are_found_exactly_when_asked(spark, docs):
    items = spark.createDataFrame([(1, "alpha beta"), (2, "Gamma"), (3, "one two three four"), (4, "alpha beta"), (5, ""), (6, "not there")], "item_id long, text string")
    rows = [(1, "x Alpha, beta y alpha beta"), (2, "alpha x beta gamma"), (3, "one two three for"), (4, "zero one two three four"), (5, "alpha"), (6, "beta")]
    got = sorted((r.doc_id, r.item_id, r.score, r.first_word, r.end_word) for r in decontaminate.find(docs(rows), items, shortest=1).collect())
    assert got == [(1, 1, 1.0, 1, 3), (1, 4, 1.0, 1, 3), (2, 2, 1.0, 3, 4), (4, 3, 1.0, 1, 5)]
    assert decontaminate.find(docs(rows), items).collect() == []
    assert sorted(r.doc_id for r in decontaminate.clean(docs(rows), items, shortest=1).collect()) == [3, 5, 6]


def test_whole_result_against_full_alignment(spark, docs, prose):
    """All documents with all items by Smith-Waterman over whole texts: every pair that shares a seed and reaches the threshold, no other."""
    r = random.Random(8)
    items = [(i, prose(700 + i, r.choice([6, 12, 25, 40]))) for i in range(12)]
    rows = []
    for i in range(60):
        w = prose(i, r.choice([0, 20, 60]))
        for _ in range(r.choice([0, 1, 2])):
            part = list(r.choice(items)[1])
            part = part[r.choice([0, 0, len(part) // 3]) :]
            for _ in range(r.choice([0, 1, 3, 8])):
                at = r.randrange(len(part))
                r.choice([lambda: part.__setitem__(at, "other"), lambda: part.insert(at, "more"), lambda: len(part) > 2 and part.pop(at)])()
            w += part + prose(300 + i, r.choice([0, 10]))
        rows.append((i, " ".join(w)))

    def full(a, b):
        row, best = [0] * (len(b) + 1), 0
        for x in a:
            new = [0]
            for j, y in enumerate(b, 1):
                new.append(max(0, row[j - 1] + (2 if x == y else -1), row[j] - 1, new[j - 1] - 1))
            row, best = new, max(best, max(new))
        return best

    grams = lambda w: {tuple(w[k : k + 3]) for k in range(len(w) - 2)}
    want, unseeded = {}, 0
    for i, t in rows:
        for j, item in items:
            score = full(item, t.split()) / (2 * len(item))
            if score >= 0.5:
                if grams(item) & grams(t.split()):
                    want[i, j] = score
                else:
                    unseeded += 1
    table = spark.createDataFrame([(j, " ".join(w)) for j, w in items], "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.score for x in decontaminate.find(docs(rows), table).collect()}
    assert got.keys() <= want.keys() and len(want) > 25 and unseeded <= len(want) // 20
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)
    assert len(got) >= 0.97 * len(want), sorted(want.keys() - got.keys())
