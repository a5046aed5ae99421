import random
from itertools import permutations

import pytest

from quillon.llm import common, license_scan, line_dedup, suffix_dedup


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def brute_lines(rows):
    seen, out = [], {}
    lines = sorted((i, k, t.split("\n")[k].split()) for i, t in rows for k in range(len(t.split("\n"))))
    for i, _, w in lines:
        n, kept, exact = out.get(i, (0, 0, 0))
        if not w:
            out[i] = (n + 1, kept + 1, exact)
            continue
        same = w in seen
        near = same or len(w) >= line_dedup.MIN_WORDS and any(len(s) >= line_dedup.MIN_WORDS and abs(len(w) - len(s)) < 2 and distance(w, s) <= 1 for s in seen)
        out[i] = (n + 1, kept + (not near), exact + same)
        if not same:
            seen.append(w)
    return out


def test_lines_equal_brute_force(docs, prose):
    r, pool, rows = random.Random(4), [], []
    for i in range(40):
        lines = []
        for k in range(8):
            w = prose(1000 + 8 * i + k, r.choice([3, 5, 6, 9, 20]))
            if pool and r.random() < 0.6:
                w = list(r.choice(pool))
                for _ in range(r.choice([0, 1, 1, 2])):
                    at = r.randrange(len(w))
                    r.choice([lambda: w.pop(at), lambda: w.insert(at, w[at]), lambda: w.insert(at, "new"), lambda: w.__setitem__(at, "other")])()
            pool.append(w)
            lines.append((" " * r.choice([1, 2])).join(w))
        rows.append((i, "\n".join(lines)))
    got = {x.doc_id: (x.n_lines, x.n_kept, x.n_exact) for x in line_dedup.summary(docs(rows)).collect()}
    assert got == brute_lines(rows)
    texts = {x.doc_id: x.text for x in line_dedup.dedup_lines(docs(rows)).collect()}
    assert {i: len(t.split("\n")) if t else 0 for i, t in texts.items() if got[i][1]} == {i: k for i, (_, k, _) in got.items() if k}


def test_lines_odd(docs, odd):
    got = {x.doc_id: x for x in line_dedup.summary(docs(odd)).collect()}
    assert got[2].n_kept == 0 and got[2].n_exact == 1 and got[3].n_kept == 1 and got[5].n_kept == 2 and got[None].n_kept == 2 and got[10].n_exact == 1
    cut = line_dedup.dedup_lines(docs(odd))
    assert cut.columns == docs([]).columns and cut.count() == len(odd)
    assert line_dedup.summary(docs([])).collect() == []


def test_short_lines_repeat_too(docs, prose):
    """With shortest=1 exact repeats of any line with words go; only lines of MIN_WORDS words meet with an edit."""
    r, rows = random.Random(5), []
    pool = [prose(300 + k, r.choice([1, 2, 3, 4, 4, 5, 6])) for k in range(25)]
    pool += [w[:-1] for w in pool if len(w) > 1]
    for i in range(30):
        rows.append((i, "\n".join("" if r.random() < 0.1 else " ".join(r.choice(pool)) for _ in range(8))))
    seen, want, texts = [], {}, {}
    for i, t in rows:
        kept = []
        for x in t.split("\n"):
            w = x.split()
            near = len(w) >= 5 and any(len(s) >= 5 and abs(len(w) - len(s)) < 2 and distance(w, s) <= 1 for s in seen)
            if not w or not (near or w in seen):
                kept.append(x)
            want[i] = want.get(i, 0) + (bool(w) and w in seen)
            if w and w not in seen:
                seen.append(w)
        texts[i] = "\n".join(kept)
    got = {x.doc_id: x.n_exact for x in line_dedup.summary(docs(rows)).collect()}
    assert got == want and sum(want.values()) > 100
    assert {x.doc_id: x.text for x in line_dedup.dedup_lines(docs(rows)).collect()} == texts
    with pytest.raises(ValueError):
        line_dedup.summary(docs(rows), shortest=0)


def brute_places(rows):
    """(n_kept, n_exact, n_near) of each doc_id: rows of one id share its places; of lines within an edit at one place neither is earlier."""
    first = {}
    for i, t in rows:
        for k, x in enumerate(t.split("\n")):
            if w := tuple(x.split()):
                first[w] = min(first.get(w, (i, k)), (i, k))
    long = {w: at for w, at in first.items() if len(w) >= 5}
    near = {w for w, at in long.items() if any(b < at and abs(len(w) - len(v)) < 2 and distance(w, v) <= 1 for v, b in long.items())}
    out = {}
    for i in {i for i, _ in rows}:
        texts = [x for j, t in rows if j == i for x in t.split("\n")]
        own = [w for w, at in first.items() if at[0] == i]
        blank, gone = sum(not x.split() for x in texts), sum(w in near for w in own)
        out[i] = (blank + len(own) - gone, len(texts) - blank - len(own), gone)
    return out


def test_lines_of_repeated_ids_in_every_order(docs, prose):
    """Texts of one id are told apart: no unique line goes, no near line is missed."""
    base = [(3, "a b c d e f"), (9, "u v w x y z"), (9, "a b c d e g"), (9, "one\nu v w x y q"), (12, "u v w x z\na b c d e f g h"), (9, "k l m n o p\nu v w x y z")]
    for order in list(permutations(range(6)))[::67]:
        rows = [base[i] for i in order]
        got = {x.doc_id: (x.n_kept, x.n_exact, x.n_near) for x in line_dedup.summary(docs(rows)).collect()}
        assert got == brute_places(rows)
    texts = sorted((x.doc_id, x.text) for x in line_dedup.dedup_lines(docs(base[:3])).collect())
    assert texts == [(3, "a b c d e f"), (9, ""), (9, "u v w x y z")]
    r = random.Random(8)
    pool = [prose(600 + k, r.choice([1, 4, 5, 6, 8])) for k in range(12)]
    pool += [[*w[:-1], "other"] for w in pool] + [w[1:] for w in pool if len(w) > 4]
    rows = [(r.randrange(5), "\n".join(" ".join(r.choice(pool)) for _ in range(r.randint(1, 4)))) for _ in range(25)]
    got = {x.doc_id: (x.n_kept, x.n_exact, x.n_near) for x in line_dedup.summary(docs(rows)).collect()}
    assert got == brute_places(rows)


def test_alike_equals_the_edit_distance():
    import pyarrow as pa

    r, a, b = random.Random(3), [], []
    for _ in range(4000):
        a.append([r.choice("abc") for _ in range(r.randint(0, 6))])
        b.append([r.choice("abc") for _ in range(r.randint(0, 6))] if r.random() < 0.5 else [x for x in a[-1] if r.random() < 0.9])
    got = line_dedup._alike(*(common.Words(*common.text_buffers(pa.array([" ".join(w) for w in x]), lower=False)) for x in (a, b)))
    assert got.tolist() == [distance(x, y) <= 1 for x, y in zip(a, b, strict=True)]


def brute_spans(rows):
    at = {}
    texts = {i: t.lower().split() for i, t in rows}
    for i, w in texts.items():
        for j in range(len(w) - 49):
            at.setdefault(tuple(w[j : j + 50]), set()).add(i)
    every, cut = {}, {}
    for i, w in texts.items():
        for j in range(len(w) - 49):
            who = at[tuple(w[j : j + 50])]
            if len(who) > 1:
                every.setdefault(i, set()).update(range(j, j + 50))
                if min(who) < i:
                    cut.setdefault(i, set()).update(range(j, j + 50))
    return every, cut


def cover(spans):
    return {k for s in spans for k in range(s["first"], s["last"])}


@pytest.mark.parametrize("n_docs", [12, 60])
def test_passages_equal_brute_force(docs, prose, n_docs):
    r = random.Random(n_docs)
    passages = [prose(500 + k, r.choice([49, 50, 51, 60, 90, 200])) for k in range(6)]
    rows = []
    for i in range(n_docs):
        w = prose(i, r.choice([0, 30, 200]))
        for _ in range(r.choice([0, 1, 1, 2, 3])):
            w += r.choice(passages) + prose(7000 + i, r.choice([0, 1, 40]))
        rows.append((i, " ".join(w)))
    every, cut = brute_spans(rows)
    got = {x.doc_id: x for x in suffix_dedup.repeats(docs(rows)).collect()}
    assert set(got) == set(every)
    for i, x in got.items():
        assert every[i] == cover(x.spans) and cut.get(i, set()) == cover(x.cut)


@pytest.mark.parametrize("held", [5_000, 20])
def test_passages_of_edited_copies_equal_brute_force(docs, prose, monkeypatch, held):
    """1,000 copies of one text, each with a few words changed, some twice in a document: many windows share each 25-gram."""
    monkeypatch.setattr(suffix_dedup, "HELD_ROWS", held, raising=False)
    r, base, rows = random.Random(9), prose(1, 200), []
    for i in range(1000):
        w = list(base)
        for at in r.sample(range(200), r.choice([2, 3, 4, 5])):
            w[at] = f"edit{r.randrange(40)}"
        rows.append((i, " ".join(w * r.choice([1, 1, 2]))))
    r.shuffle(rows)
    every, cut = brute_spans(rows)
    got = {x.doc_id: x for x in suffix_dedup.repeats(docs(rows)).collect()}
    assert {i: cover(x.spans) for i, x in got.items()} == every
    assert {i: cover(x.cut) for i, x in got.items() if x.cut} == cut


def test_cut_repeats_keeps_one_copy(docs, prose):
    p = " ".join(prose(1, 80))
    rows = [(1, "Alpha beta, " + p + " gamma."), (2, "Delta " + p + " epsilon."), (3, "É zeta  eta")]
    got = {r.doc_id: r.text for r in suffix_dedup.cut_repeats(docs(rows)).collect()}
    assert got[1] == rows[0][1] and got[3] == rows[2][1] and "epsilon." in got[2] and len(got[2]) < 40


def test_passages_of_repeated_ids_in_every_order(docs, prose):
    """Spans are those of one text: nothing is cut from another text of the same id."""
    p, long_ = prose(1, 80), prose(5, 260)
    base = [(1, " ".join(p)), (2, " ".join(prose(2, 100) + p)), (2, " ".join(prose(3, 5))), (2, " ".join(long_)), (2, " ".join(p[:60] + prose(6, 30)))]
    want = sorted([base[0], (2, " ".join(prose(2, 100)) + " "), base[2], base[3], (2, " " + " ".join(prose(6, 30)))])
    for order in list(permutations(range(5)))[::31]:
        rows = [base[i] for i in order]
        assert sorted((r.doc_id, r.text) for r in suffix_dedup.cut_repeats(docs(rows)).collect()) == want
        spans = sorted((r.doc_id, r.n_words, [tuple(x) for x in r.cut]) for r in suffix_dedup.repeats(docs(rows)).collect())
        assert spans == [(1, 80, []), (2, 60, [(0, 60)]), (2, 80, [(100, 180)])]
    assert suffix_dedup.repeats(docs([base[1], base[4]])).collect() == []  # one document


def test_two_neighbours_are_extended_to_both_sides(docs, prose, monkeypatch):
    """A 25-gram of two suffixes needs no windows."""
    monkeypatch.setattr(suffix_dedup, "_windows", None)
    p = prose(1, 120)
    a, b = prose(2, 30) + p + prose(3, 30), prose(4, 70) + p + prose(5, 9)
    rows = suffix_dedup.suffixes(docs([(1, " ".join(a)), (2, " ".join(b))])).orderBy("key", "after", "doc", "pos").toArrow()
    spans = [x for batch in suffix_dedup._settled(rows, __import__("numpy").zeros(len(rows), bool)) for x in batch.to_pylist()]
    assert cover([x for x in spans if x["doc"] == 1]) == set(range(30, 150)) and cover([x for x in spans if x["doc"] == 2]) == set(range(70, 190))
    assert {(x["doc"], x["cut"]) for x in spans} == {(1, False), (2, True)}


def test_passages_odd(docs, odd):
    got = {x.doc_id: x for x in suffix_dedup.repeats(docs(odd)).collect()}
    assert set(got) == {1, 2, 6, 10} and got[1].cut == [] and got[10].n_words == 30_000 and len(got[10].cut) == 1
    assert suffix_dedup.cut_repeats(docs(odd)).count() == len(odd)
    assert suffix_dedup.repeats(docs([])).collect() == []


def test_a_passage_repeated_in_one_document_only_is_left(docs, prose):
    p = prose(1, 70)
    assert suffix_dedup.repeats(docs([(1, " ".join(p + prose(2, 9) + p)), (2, " ".join(prose(3, 100)))])).collect() == []


def test_licenses(docs, prose, odd):
    t = license_scan.TEMPLATES
    before, after = prose(1, 500), prose(2, 300)
    edited = t["MIT-text"].replace("free of charge, ", "").replace("Software without", "Program without")
    rows = [(1, " ".join(before) + "\n" + t["GPL-3.0"] + "\n" + " ".join(after)), (2, " ".join(before) + " " + edited), (3, " ".join(before)), (4, "licensed under the terms of a license, version of our own"), (5, t["MIT"] + " " + " ".join(before) + " " + t["MIT"])]
    got = sorted((r.doc_id, r.license, round(r.coverage, 2), r.first_word, r.end_word) for r in license_scan.find(docs(rows)).collect())
    n = len(license_scan.words_of(t["GPL-3.0"]))
    assert got[0] == (1, "GPL-3.0", 1.0, 500, 500 + n)
    assert [g[:2] for g in got[1:]] == [(2, "MIT-text"), (5, "MIT"), (5, "MIT")] and got[1][2] > 0.9 and got[1][3] == 500
    assert license_scan.find(docs(odd)).collect() == [] and license_scan.find(docs([])).collect() == []
    with pytest.raises(ValueError):
        license_scan.find(docs(rows), {"short": "two words"})


def test_one_edit_at_each_place_of_short_licenses(docs, prose):
    around, rows, want = " ".join(prose(3, 30)), [], {}
    for name, text in license_scan.TEMPLATES.items():
        w = text.split()
        if not 5 <= len(license_scan.words_of(text)) <= 20:
            continue
        for at in range(len(w)):
            for edited in (w[:at] + ["zzz"] + w[at + 1 :], w[:at] + ["zzz"] + w[at:]):
                n, kept = len(license_scan.words_of(text)), len(license_scan.words_of(text)) - (len(license_scan.words_of(w[at])) if len(edited) == len(w) else 0)
                if kept / n >= license_scan.THRESHOLD:
                    want[len(rows)] = name
                    rows.append((len(rows), f"{around} {' '.join(edited)} {around}"))
    rows.append((len(rows), around + " Released under the terms of the MIT License. " + around))
    want[len(rows) - 1] = "MIT"
    got = {(r.doc_id, r.license) for r in license_scan.find(docs(rows)).collect()}
    assert set(want.items()) <= got and len(want) > 80


def test_banded_alignment_against_brute_force():
    """Matched words equal those of a full local alignment where the band does not bind."""
    import numpy as np

    r = random.Random(1)
    for _ in range(30):
        a = [r.randrange(8) + 10 for _ in range(12)]
        b = [x for x in a if r.random() > 0.15]
        b.insert(r.randrange(len(b)), 99)
        text = [50, 51] + b + [52]
        best, row = 0, [0] * (len(text) + 1)
        for x in a:
            prev, new = 0, [0]
            for j, y in enumerate(text, 1):
                new.append(max(0, row[j - 1] + (16 if x == y else -1), row[j] - 1, new[j - 1] - 1))
            row = new
            best = max(best, max(row))
        matched, first, end = license_scan.align(np.array(a, np.uint64), [np.array(text, np.uint64)], np.array([2]), 8)
        assert 16 * matched[0] >= best and 16 * matched[0] - best <= 16
        assert 0 <= first[0] < end[0] <= len(text)


def test_columns_of_any_name_pass(spark, prose):
    p = " ".join(prose(1, 80))
    rows = [(i, f"{p} {i}\nthe same line of six words", "a", "b", "c", 1, "d") for i in (1, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id string, _cut string, _keep string, `a.b` int, line string")
    for op in (line_dedup.dedup_lines, suffix_dedup.cut_repeats):
        got = op(df)
        assert got.columns == df.columns
        first, second = sorted(got.collect())
        assert tuple(first) == rows[0] and second[2:] == rows[1][2:] and len(second.text) < len(rows[1][1])


def test_minimisers_do_not_depend_on_the_step(prose, monkeypatch):
    import numpy as np
    import pyarrow as pa

    w = common.Words(*common.text_buffers(pa.array([" ".join(prose(1, 900)), "", " ".join(prose(2, 300))])))
    want = suffix_dedup.minimisers(w)
    monkeypatch.setattr(suffix_dedup, "STEP", 64)
    assert all(np.array_equal(a, b) for a, b in zip(suffix_dedup.minimisers(w), want, strict=True))


def test_whole_result_of_licenses_against_full_alignment(docs, prose):
    """All texts with all templates, the matched words of a full alignment: what covers the threshold is found, nothing else.

    Only a template whose words lie in another one with gaps wider than the band is not.
    """
    r, t, rows = random.Random(2), license_scan.TEMPLATES, []
    for i, name in enumerate([*sorted(t), *sorted(t)]):
        w = t[name].split()
        for _ in range(len(w) // 12 if i % 2 else 0):
            w[r.randrange(len(w))] = f"changed{r.randrange(9)}"
        rows.append((i, " ".join(prose(i, 30) + w + prose(100 + i, 30))))

    def covered(a, b):
        """Most matched words of the best local alignment."""
        row, best = [(0, 0)] * (len(b) + 1), (0, 0)
        for x in a:
            new = [(0, 0)]
            for j, y in enumerate(b, 1):
                p = row[j - 1]
                new.append(max((0, 0), (p[0] + 16, p[1] + 1) if x == y else (p[0] - 1, p[1]), (row[j][0] - 1, row[j][1]), (new[j - 1][0] - 1, new[j - 1][1])))
            row, best = new, max(best, max(new))
        return best[1] / len(a)

    words = {n: license_scan.words_of(x).tolist() for n, x in t.items()}
    want = {(i, n) for i, x in rows for n in t if covered(words[n], license_scan.words_of(x).tolist()) >= license_scan.THRESHOLD}
    got = {(x.doc_id, x.license) for x in license_scan.find(docs(rows)).collect()}
    wide = {("GPL-3.0", n) for n in t if n.endswith("GPL-3.0-notice") or n.endswith("GPL-2.0-notice") or n.startswith("LGPL")}
    names = [*sorted(t), *sorted(t)]
    assert got <= want and {(n, names[i]) for i, n in want - got} <= wide and len(got) >= 2 * len(t) - 6


def test_templates_of_a_folder(tmp_path, docs, prose):
    (tmp_path / "OWN-1").write_text(" ".join(prose(1, 12_000)))
    (tmp_path / "tiny").write_text("two words")
    found = license_scan.templates_in(str(tmp_path))
    assert sorted(found) == ["OWN-1#1", "OWN-1#2", "OWN-1#3"]
    got = license_scan.find(docs([(1, " ".join(prose(2, 50) + prose(1, 12_000)))]), found).collect()
    assert sorted(x.license for x in got) == sorted(found)


def test_short_lines_meet_with_an_edit_if_asked(docs, prose, monkeypatch):
    """edit_words=1 compares lines of any length, as by brute force; counts are those of the texts that were cut."""
    r = random.Random(6)
    pool = [prose(500 + k, r.choice([1, 2, 2, 3, 4, 5, 6])) for k in range(20)]
    pool += [[*w[:-1], "x"] for w in pool if len(w) > 2]
    rows = [(i, "\n".join(" ".join(r.choice(pool)) for _ in range(4))) for i in range(12)]
    got = {x.doc_id: (x.n_lines, x.n_kept, x.n_exact) for x in line_dedup.summary(docs(rows), edit_words=1).collect()}
    texts = {x.doc_id: x.text for x in line_dedup.dedup_lines(docs(rows), edit_words=1).collect()}
    monkeypatch.setattr(line_dedup, "MIN_WORDS", 1)
    assert got == brute_lines(rows)
    assert {i: len(t.split("\n")) if t else 0 for i, t in texts.items()} == {i: x[1] for i, x in got.items()}


def test_the_query_cuts_the_texts(docs, prose, monkeypatch):
    """The query's counts are taken from the operator's cut texts, not from a way of their own."""
    rows, real, cut = [(1, " ".join(prose(1, 9))), (2, " ".join(prose(1, 9)) + "\nanother line")], line_dedup._cut, []
    monkeypatch.setattr(line_dedup, "_cut", lambda *a: cut.append(real(*a)) or cut[-1])
    monkeypatch.setattr(line_dedup, "table", lambda *a: docs(rows))
    assert {x.doc_id: (x.n_kept, x.n_exact) for x in line_dedup.query(None, "").collect()} == {1: (1, 0), 2: (1, 1)}
    assert len(cut) == 1 and "text" in cut[0][0].columns
