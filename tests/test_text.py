import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.functions import text as tx

ODD = ["", " ", "a b  c\x1c", "Straße über/alles-klar_x ./:-_", "ABC-12 topic X1", "x" * 700, "µ ﬁne ſo", "tool result: y", "a-b/c.d:e_f", "The --the-- of/and"]


def py_tokens(text):
    out = []
    for t in re.findall(tx.TOKEN, text.casefold()):
        clean = t.strip(tx.EDGE)
        if len(clean) >= 2 and clean not in tx.STOPWORDS:
            out += [clean] + [p for sep in "/-" if sep in t for p in t.split(sep) if len(p) >= 2]
    return out


def check(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r for r in df.select("i", tx.normalize("t").alias("n"), tx.tokens("t").alias("k"), tx.truncate(tx.normalize("t"), 20).alias("s")).collect()}
    for i, t in enumerate(texts):
        n = " ".join(t.split())
        assert got[i].n == n
        assert got[i].k == py_tokens(t)
        assert got[i].s == (n if len(n) <= 20 else n[:17].rstrip() + "...")


def test_against_python(spark):
    check(spark, ODD)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(st.characters(min_codepoint=9, max_codepoint=0x24FF), max_size=60), min_size=30, max_size=30))
def test_random_texts(spark, texts):
    check(spark, texts)


def test_null_is_empty(spark):
    r = spark.createDataFrame([(None,)], "t string").select(tx.normalize("t").alias("n"), tx.tokens("t").alias("k"), tx.identifier_count("t").alias("c"), tx.has_anchor("t").alias("a")).first()
    assert (r.n, r.k, r.c, r.a) == ("", [], 0, False)


def test_importance(spark):
    rows = [("plain", "user", 2.2), ("PMID 1 PMID 2 FHIR CKD topic A", "tool", 3.0), ("x" * 601, "assistant", 0.9), ("x" * 600, "assistant", 1.2)]
    df = spark.createDataFrame(rows, "t string, k string, w double")
    for r in df.select("w", tx.importance(F.col("t"), F.col("k")).alias("x")).collect():
        assert abs(r.x - r.w) < 1e-12


def test_case_folding_is_that_of_python(spark):
    """Every letter of the basic plane that Java's tables know, alone and inside a token."""
    letters = [chr(c) for c in range(32, 0xFFFF) if not 0xD800 <= c < 0xE000 and chr(c).casefold() != chr(c) and c not in (0x1C89, 0xA7CB, 0xA7CC, 0xA7DA, 0xA7DC)]
    df = spark.createDataFrame([(c, f"a{c}b") for c in letters], "c string, t string")
    got = df.select("c", tx.casefold("t").alias("f"), tx.tokens("t").alias("k")).collect()
    assert [(r.c, r.f) for r in got if r.f != f"a{r.c}b".casefold()] == []
    assert [(r.c, r.k) for r in got if r.k != py_tokens(f"a{r.c}b")] == []
    assert spark.createDataFrame([("ŉab ΣΑΣ",)], "t string").select(tx.tokens("t").alias("k")).first().k == ["nab"]


def test_tokens_in_pieces_and_runs_of_space(spark, monkeypatch):
    """Texts beyond a piece, nulls and empty ones keep their places; a single space is no run, all others become one."""
    import pyarrow as pa

    texts = [None, "", "Alpha-Beta the x/y", "word " * 50, None, "PMID:12."]
    monkeypatch.setattr(tx, "PIECE", 8)
    assert tx._in_pieces(pa.array(texts, pa.string()), tx._index_tokens).to_pylist() == [py_tokens(t or "") for t in texts]
    assert tx._in_pieces(pa.array([], pa.string()), tx._index_tokens).to_pylist() == []
    check(spark, ["a \n b", "\n a", "a b", "   a  b ", "a b c", "  ", "a\tb \x1fc\x1f"])


def test_tokens_make_no_calls_for_each_word():
    """F16: tokens are found on bytes; what Python calls does not grow with the words, but for compound ones."""
    import sys

    import pyarrow as pa

    def calls(words):
        text, seen = pa.array([" ".join(f"Word{i} and" for i in range(words))]), []
        sys.setprofile(lambda frame, event, arg: seen.append(event))
        try:
            got = tx._in_pieces(text, tx._index_tokens)
        finally:
            sys.setprofile(None)
        assert got.to_pylist() == [[f"word{i}" for i in range(words)]]
        return len(seen)

    assert calls(20_000) < 2 * calls(200)


def test_tokens_end_with_their_text():
    """F16: texts lie side by side in a batch, sliced or not, of either string type; letters that fold to ASCII begin and end tokens."""
    import pyarrow as pa

    texts = ["x", "ab-", "cd", "", "-ef", "the", "Ka/bc.", "ß-ﬁ", None, "g\x00h-ij", "k" * 70 + "_"]
    for kind in (pa.string(), pa.large_string()):
        for of, plain in ((tx._index_tokens, py_tokens), (tx._hash_tokens, py_hash_tokens)):
            assert tx._in_pieces(pa.array(texts, kind).slice(1), of).to_pylist() == [plain(t or "") for t in texts[1:]]


def py_hash_tokens(text):
    return [x for t in re.findall(tx.TOKEN, text.casefold()) for x in [t, *[p for sep in "/-" if sep in t for p in t.split(sep) if len(p) >= 2]]]


def test_white_space_is_sought_quickly(spark):
    """of a text whose spaces are single ones, each character is ruled out at once, not range by range (2 x as quick)."""
    import time

    jvm = spark._jvm
    text = jvm.java.lang.String.join("", jvm.java.util.Collections.nCopies(40_000, "words of a plain text, and some more of it "))
    plain = rf"(?: {tx.SPACE}|{tx.SPACE.replace('\\x20', '\\x1f')}){tx.SPACE}*+"

    def seconds(pattern):
        found, best = jvm.java.util.regex.Pattern.compile(pattern), 9.0
        for _ in range(6):
            began = time.perf_counter()
            assert not found.matcher(text).find()
            best = min(best, time.perf_counter() - began)
        return best

    assert seconds(tx.RUN) < 0.85 * seconds(plain)


def test_every_white_space_is_found(spark):
    """each space character alone, doubled, at the ends and beside letters next to the ranges that are ruled out."""
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    near = ["!", "~", "\x7f", "\x84", "\x86", "\x9f", "\xa1", "\u167f", "\u1681", "é", "日", "𝒜"]
    check(spark, [x for s in spaces for x in (s, s + s, f"{s}a{s}b{s}{s}c {s}", f" {s}x")] + [f" {n}  {n}\t{n}\u3000" for n in near])
    rows = spark.createDataFrame([(s,) for s in spaces], "s string").select("s", tx.strip(F.concat("s", "s", F.lit("a"), "s", F.lit("b"), "s")).alias("x")).collect()
    assert [r.x for r in rows] == [f"a{r.s}b" for r in rows]
