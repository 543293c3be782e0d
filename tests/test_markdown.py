import pytest
from docweave.functions import markdown as m


def test_fences():
    text = "a\n```py\n~~~\n```\n> ~~~~\n> x\n> ~~~\n> ~~~~\n- ```\n  y\n  ```\n"
    got = m.fences(text)
    assert [(b["start_line"], b["end_line"], b["marker"], b["blockquote_depth"], b["container_indent"]) for b in got] == [(2, 4, "`", 0, 0), (5, 8, "~", 1, 0), (9, 11, "`", 0, 2)]
    assert m.without_fences("a\n```\nb\n```\nc\n") == "a\n\n\n\nc\n"
    assert m.fences("``` a`b\n") == []


@pytest.mark.parametrize(("text", "why"), [("```\nx", "unclosed"), ("````\n```\n", "shorter"), ("```\n~~~\n", "different marker"), ("```\n``` x\n", "trailing text"), ("```\n    ```\n", "exceeds three"), ("> ```\n```\n", "blockquote depth")])
def test_open_fences(text, why):
    with pytest.raises(m.Fence, match=why):
        m.fences(text)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("你好，我是张三。\n正文。\n我们下节课再见！\n", "正文。\n"),
        ("**大家好！今天讲树。**\n", "**今天讲树。**\n"),
        ("你好我是谁？\n", "你好我是谁？\n"),
        ("# 欢迎来到这里\n", "# 欢迎来到这里\n"),
        ("正文。我们下节课再见！", "正文。"),
        ("a\r\nb\r\n", "a\nb\n"),
        ("", ""),
    ],
)
def test_greetings(text, want):
    assert m.without_greetings(text) == want


@pytest.mark.parametrize(
    ("line", "want"),
    [("有 $n$ 个", "有 $n$ 个"), ("率$r_t$是", "率 $r_t$ 是"), ("率$$x$$是", "率$$x$$是"), ("a  $x$   b", "a $x$ b")],
)
def test_spacing(line, want):
    assert m.spaced(line) == want


@pytest.mark.parametrize(("line", "want"), [("$x+y$", "$$x+y$$"), ("  $x$ ", "$$x$$"), ("$a$ $b$", "$a$ $b$"), ("$$x$$", "$$x$$"), ("$ $", "$ $")])
def test_promotion(line, want):
    assert m.promoted(line) == want


@pytest.mark.parametrize(
    ("math", "want"),
    [(r"\sigma", r"\sigma"), (r"a\,b", r"a\\,b"), (r"a\\_b", r"a\\_b"), (r"a\_b", r"a\_b"), (r"a \\ b", r"a \\\\ b"), (r"a \\\\ b", r"a \\\\ b"), ("x\\", "x\\\\")],
)
def test_backslashes(math, want):
    assert m.doubled(math) == want
    if not math.endswith("\\"):  # a lone one at the end can't be told from a line break
        assert m.doubled(m.doubled(math)) == m.doubled(math)


def test_inline_and_blocks():
    assert m.math_escaped("$x_t$ and $y_{a}$", set()) == r"$x\_t$ and $y\_{a}$"
    assert m.math_escaped("$$\na_b \\\\ c\n$$", set()) == "$$\na_b \\\\\\\\ c\n$$"
    assert m.math_escaped("$$\na\\,b", set()) == "$$\na\\,b"


def test_captions():
    want = '<div align="center">\n\n**图 8-1　标题**\n\n</div>'
    for text in ("图 8-1　标题", "**图 8-1　标题**", '<div align="center"><strong>图 8-1　标题</strong></div>', want):
        assert m.captions(text, set()) == want
    table = '<div align="center">\n\n**表 1　t**\n| a |\n\n</div>'
    assert m.captions(table, set()) == table
    assert m.captions("图 6-1 把", set()) == "图 6-1 把"


def test_all_rules_and_placeholders():
    text = "大家好，\n\n**a****b**\n$x_1$\n```\n$y_1$****\n```\n{{FORMULA:formula-0001}}\n"
    out = m.postprocessed(text)
    assert "****" in out and "**ab**" in out and "$$x_1$$" in out and "$y_1$****" in out
    assert m.postprocessed(out) == out
    assert m.placeholders(out) == [(out.split("\n").index("{{FORMULA:formula-0001}}") + 1, "{{FORMULA:formula-0001}}")]
