import pytest
from pyspark.sql import functions as F

from adfacts.functions import rules as R
from adfacts.functions import text as T


HTML_CASES = [
    (None, ""),
    ("", ""),
    ("plain", "plain"),
    ("<p>one</p><p> two <b>three</b> four</p>", "one\ntwo\nthree\nfour"),
    ("a<br>b<br/>c", "a\nb\nc"),
    ("  \n a \n\n b \n", "a\nb"),
    ("x<!-- <p>hidden</p> -->y", "x\ny"),
    ('<script>var t="</p><b>";</script>after', "after"),
    ("<STYLE type='x'>p{}</STYLE>after", "after"),
    ("before<script>never closed <p>x</p>", "before"),
    ("<template><p>no</p></template><ruby>kan<rp>(</rp><rt>ji</rt></ruby>", "kan"),
    ("<!DOCTYPE html><?xml version='1'?><html>t</html>", "t"),
    ('<a title="x > y" href=z>link</a>', "link"),
    ('<a title="never closed>link</a> tail', "link\ntail"),
    ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
    ("Tom &amp; Jerry &lt;b&gt;", "Tom & Jerry <b>"),
    ("&amp;lt;", "&lt;"),
    ("&euro;5 &eacute;t&eacute &unknown; R&D &", "€5 été &unknown R&D &"),
    ("it&apos;s &lbrace;x&rbrace; &hellip; &NotEqualTilde; &AMP;", "it's {x} … ≂̸ &"),
    ("&#8364; &#x20AC; &#128640; &#150; &#0; &#99999999999999999999;", "€ € 🚀 – � �"),
    ("\xa0 <p>\xa0a\xa0b\xa0</p>", "a\xa0b"),
    ("<p>&nbsp;x&nbsp;y&nbsp;</p>", "x\xa0y"),
]


def test_html_to_text(values):
    out = values(T.html_to_text, [(html,) for html, _ in HTML_CASES], "h string")
    for (html, text), got in zip(HTML_CASES, out):
        assert got == text, html


def test_long_runs_take_no_stack(values):
    blanks = " " * 200_000
    many = "<a " + 'x="1" ' * 50_000 + "y='>'>t</a>"
    amounts = "1" + ",234" * 50_000
    assert values(T.html_to_text, [(many,), (f"<p>{blanks}x{blanks}</p>",)], "h string") == ["t", "x"]
    html = f"<h3>{blanks}Compensation{blanks}&nbsp;</h3>{blanks}<p>{blanks}12</p>"
    assert tuple(values(R.compensation, [(html, "SG")], "h string, n string")[0]) == (12, 12)
    assert tuple(values(R.salary_range, [(f"{amounts}% or 50",)], "t string")[0]) == (50, 50)


def test_text_is_read_whole(values):
    html = "<p>word</p>" * 50_000 + "<b>last"
    (out,) = values(T.html_to_text, [(html,)], "h string")
    assert out == "\n".join(["word"] * 50_000 + ["last"])


def test_remove_emojis(values):
    rows = [("Clerk 🚀🚀",), ("a😀b🇦🇺c",), ("☂ stays",), (None,)]
    assert values(T.remove_emojis, rows, "t string") == ["Clerk ", "abc", "☂ stays", None]


def test_prompts_parse_twice_and_keep_going_on_nulls(values):
    rows = [(" T 😀", "<p>ad &lt;b&gt;bold&lt;/b&gt;</p>", "AUS", None)]
    names = "a string, b string, c string, d string"
    assert values(T.salary_prompt, rows, names) == ["T  ad\nbold\nAUS"]
    rows = [(None, " sum ", "<p>x</p>", None, "sub")]
    assert values(T.seniority_prompt, rows, names + ", e string") == ["sum x  sub"]
    assert values(T.arrangement_prompt, [(None,)], "a string") == [""]


def test_strip_tags_and_joined_text(values):
    assert values(T.strip_tags, [("<p>a</p>\n <b>b</b>\t",)], "t string") == ["a b"]
    assert values(T.joined_text, [("a", None, "c")], "a string, b string, c string") == ["a  c"]
    assert values(T.lowered, [("ABC",), (None,)], "t string") == ["abc", ""]


def test_prompt_templates(values):
    tagged = values(lambda c: T.tagged_prompt(c, "salary"), [("ad",)], "t string")
    assert tagged == [
        "[TASK: Salary] Extract salary information from the job ad. \n\njob ad: \nad\n\n"
    ]
    (zero,) = values(lambda c: T.zero_shot_prompt(c, "arrangement"), [(" ad ",)], "t string")
    assert zero.startswith("You are a job arrangement classifier.\n")
    assert zero.endswith("nothing else.\n\nJob Advertisement:\nad\n")
    for build in (T.tagged_prompt, T.zero_shot_prompt):
        with pytest.raises(ValueError):
            build(F.lit("x"), "other")
    rows = [("p", "Salary"), ("p", "default")]
    salary, other = values(T.expert_prompt, rows, "p string, t string")
    assert salary.endswith("Input: p\n    \n    Output:") and other == "p"


def test_task_type_order(values):
    both = "[TASK: Seniority] [TASK: Salary]"
    rows = [(both,), ("[TASK: Work Arrangement]",), ("x",), (None,)]
    assert values(T.task_type, rows, "p string") == [
        "Salary", "Work Arrangement", "Unknown", "Unknown",
    ]


HEADED = "job title:  Cook \nlost\nEmployer: A\n employer : B\r\nLocation:\nCONTENTS: x\nLocation: tail\n"


def test_split_and_build_header(values):
    (h,) = values(T.split_header, [(HEADED,)], "p string")
    assert h.asDict() == {
        "job_title": "Cook", "abstract": None, "employer": "B", "location": "",
        "highlights": None, "tail": "CONTENTS: x\nLocation: tail",
    }
    (text,) = values(lambda c: T.build_header(T.split_header(c)), [(HEADED,)], "p string")
    assert text == "Job Title: Cook\nEmployer: B\nLocation: \nCONTENTS: x\nLocation: tail"
    (empty,) = values(lambda c: T.build_header(T.split_header(c)), [(None,)], "p string")
    assert empty == ""


def test_message_preview(values):
    rows = [(0, "User", " hi "), (1, None, "x" * 201), (2, "C", "y" * 200)]
    out = values(T.message_preview, rows, "i int, n string, c string")
    assert out == ["[1] User: hi", "[2] Unknown: " + "x" * 200 + "...", "[3] C: " + "y" * 200]
