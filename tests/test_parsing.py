import pytest
from hypothesis import given
from hypothesis import strategies as st

from papyra.functions import markdown as M
from papyra.functions import parsing as P
from papyra.functions import quality, tex
from papyra.functions import text as T


def test_markdown_blocks():
    text = "# T\n\nbody\nmore\n\n```\ncode\n\nstill\n```\n\n| a |\n|---|\n\n- x\n\n> q\n\n![i](p.png)\n\n$$x$$"
    assert [b["kind"] for b in M.markdown_blocks(text)] == ["heading", "paragraph", "code", "table", "list", "quote", "image", "formula"]


@pytest.mark.parametrize("text", ["", "\n\n", "   "])
def test_markdown_without_blocks(text):
    assert M.markdown_blocks(text) == []


def test_table_grid_spans():
    grid = P.table_grid("<table><tr><td rowspan=2>a</td><td>b</td></tr><tr><td>c</td></tr></table>")
    assert [(c["row"], c["column"], c["text"]) for c in grid] == [(0, 0, "a"), (0, 1, "b"), (1, 1, "c")]


@pytest.mark.parametrize("text", ["", "<table><tr><td>a</td></tr><tr></tr></table>", "<table><tr><td><table></table></td></tr></table>", "<table><tr><td colspan=2>a</td></tr><tr><td>b</td></tr></table>"])
def test_table_grid_refuses(text):
    assert P.table_grid(text) is None


def test_json_objects_from_a_cut_text():
    assert P.json_objects('x {"l":[{"a":"}"},{"b":1},{"c":') == ['{"a":"}"}', '{"b":1}']
    assert P.json_objects("") == []


@given(st.text(max_size=200))
def test_protect_round_trip(text):
    if "⟦" in text or "[" in text or "]" in text or "⟧" in text:
        return
    p = P.protect(text)
    assert P.restore(p["text"], p["kept"]) == text


def test_fit_columns():
    assert P.fit_columns([30, 30], [30, 30], 100) == [50, 50]
    assert P.fit_columns([60, 60], [60, 60], 100) is None


def test_redacted_json():
    assert P.redacted_json('{"a":{"secret_key":1}}') == '{"a":{"secret_key":"[REDACTED]"}}'
    assert P.redacted_json("{") is None


def test_markdown_offsets():
    text = "a\n\n\n```\nx\n\ny\n```\nafter\n\n- b"
    blocks = M.markdown_blocks(text)
    assert [text[b["start"] : b["stop"]] for b in blocks] == [b["text"] for b in blocks] == ["a", "```\nx\n\ny\n```\nafter", "- b"]


def lanes(text: str) -> str:
    """The fingerprint, unit by unit."""
    units = text.replace("\r\n", "\n").replace("\r", "\n").replace("\0", "").encode("utf-16-le", "surrogatepass")
    a, b = 0x811C9DC5, 0x9E3779B9
    for i in range(0, len(units), 2):
        u = units[i] | units[i + 1] << 8
        a = (a ^ u) * 0x01000193 % 2**32
        b = (b ^ (u + (i // 2 + 1) * 131)) * 0x85EBCA6B % 2**32
    return f"{a:08x}{b:08x}"


def _values(spark, column, texts):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string").select("i", column(F.col("s")).alias("v"))
    return [r.v for r in rows.orderBy("i").collect()]


def test_fingerprint(spark):
    texts = ["", "a", "a\r\nb", "a\nb", "é😀ü", "x" * 5000, "tab\tand nul\0!"]
    assert _values(spark, T.fingerprint, texts) == [lanes(t) for t in texts]


def test_safe_stem(spark):
    texts = ["a/b:c", " x . . ", "con", "Lpt1.txt", "console", "", "n" * 120, None]
    got = _values(spark, T.safe_stem, texts)
    assert got[0] == "a_b_c" and got[1] == "x" and got[4] == "console"
    assert got[2].startswith("document_") and got[3].startswith("document_") and got[5] == got[7] and len(got[5]) == 17
    assert len(got[6]) == 96 and got[6].startswith("n" * 87 + "_")


def test_without_local_paths(spark):
    texts = ["C:\\a b\nnext", "see \\\\srv\\share\\f and more", "http:\\\\doi.org\\10.1 ok", "a \\\\ = b", "https://x.y/z D:/q http://after", "no", "x\r\nE:/y\r\nz", ""]
    note = T.PATH_NOTICE
    assert _values(spark, T.without_local_paths, texts) == [f"{note}\nnext", f"see {note}", "http:\\\\doi.org\\10.1 ok", "a \\\\ = b", f"https://x.y/z {note}", "no", f"x\r\n{note}\r\nz", ""]


def test_table_grid_with_huge_spans():
    assert P.table_grid('<table><tr><td rowspan="99999999">a</td></tr></table>') is None
    assert P.table_grid('<table><tr><td colspan="999999999999">a</td></tr></table>') is not None  # beyond nine digits a span is none


def test_json_objects_of_deep_nesting():
    deep = '{"a":' * 3000 + '{"b":1}' + "}" * 10
    assert P.json_objects(deep)[0].count("{") >= 1
    assert P.json_objects('{"a":{"b":"}"}} x {"c":2} "{not}"') == ['{"a":{"b":"}"}}', '{"c":2}']


@given(st.text(alphabet="ab \n", max_size=60), st.text(alphabet="ab \n", max_size=60))
def test_bigram_coverage(a, b):
    from collections import Counter

    def grams(t):
        s = "".join(t.split())
        return Counter(x + y for x, y in zip(s, s[1:], strict=False))

    x, y = grams(a), grams(b)
    want = sum((x & y).values()) / sum(x.values()) if x else None
    assert quality.bigram_coverage(a, b) == want


@pytest.mark.parametrize(
    "text,kinds",
    [
        ("a $x$ b", ["text", "math", "text"]),
        ("\\$5 and $6", ["text"]),
        ("`$x$` $$y$$", ["text", "math"]),
        ("``a`$b$`` \\(c\\)", ["text", "math"]),
        ("\\\\(no\\) \\[z\\]", ["text", "math"]),
        ("$ $", ["text"]),
        ("$a\nb$", ["text"]),
        ("`open $x$", ["text"]),
        ("", []),
    ],
)
def test_math_tokens(text, kinds):
    got = tex.math_tokens(text)
    assert [t["kind"] for t in got] == kinds and "".join(t["text"] for t in got) == text


@given(st.text(alphabet="a. \n!x", max_size=80), st.integers(1, 20))
def test_comparable_tex_is_stable(text, n):
    once = tex.comparable_tex("{" * n + text + "}" * n)
    assert tex.comparable_tex(once) == once


@pytest.mark.parametrize("limit", [1, 7, 40])
def test_split_text(spark, limit):
    texts = ["", "a", "One. Two! Three?", "line\n\nline  x. y", "x" * 50, "。".join(["句子" * 5] * 6), " \n "]
    for text, parts in zip(texts, _values(spark, lambda c: M.split_text(c, limit), texts), strict=True):
        assert "".join(parts) == text and all(0 < len(p) <= limit for p in parts)
