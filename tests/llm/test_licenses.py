import random
import textwrap

import pytest
from edges import EDGES

from adfacts.llm import licenses as L

NAME = "op9_licenses"


def planted():
    rng = random.Random(3)
    texts = [t for t, _ in L.TEMPLATES] + [p for p, _ in L.PHRASES]
    common = "the of and to in a license under is version mit work that any are".split()
    docs = list(EDGES)
    for i in range(100, 200):
        lines = [" ".join(rng.choices(common, k=rng.randrange(1, 40))) for _ in range(rng.randrange(1, 4))]
        words = rng.choice(texts).split()
        if i % 4 == 1:
            del words[rng.randrange(len(words))]
        if i % 4 == 2:
            rng.shuffle(words)
        line = rng.choice([" ", ", ", "--"]).join(words)
        lines.insert(rng.randrange(len(lines) + 1), line.upper() if i % 3 else line.title())
        docs.append((i, "\n".join(lines), "en", "s", 1))
    docs += [
        (300, "under the MIT license under the mit license, cc-by-nc", "en", "s", 1),
        (301, "sunder the mit licenses", "en", "s", 1),
        (302, "Apache License,\nVersion 2.0", "en", "s", 1),
        (303, "cc by nc", "en", "s", 1), (303, "cc by nc", "en", "s", 1), (303, "cc by", "en", "s", 1),
        (304, "worK this is licensed under the gnu general public license version 3", "en", "s", 1),
    ]
    return docs


def test_matches_sql_without_filters(spark, folder, matches):
    rows = matches(L, NAME, folder(documents=planted()))
    assert len(rows) == len(planted())
    out = {r["doc_id"]: r for r in L.QUERIES[NAME](spark, folder(documents=planted())).collect()}
    assert (out[300]["n_base"], out[300]["first_word"], out[300]["last_word"]) == (3, 0, 8)
    assert out[300]["labels"] == "cc-by-nc,mit" and out[301]["n_base"] == 0
    assert out[302]["base_labels"] == "apache-2"
    assert out[1]["n_words"] == 0 and out[1]["score"] == 0.0


@pytest.mark.parametrize("width", [40, 60, 80])
def test_wrapped_templates_are_found_wherever_they_stand(spark, folder, matches, width):
    rng = random.Random(width)
    docs, want = [], {}
    for i, (text, label) in enumerate(L.TEMPLATES):
        for j, mark in enumerate(("", " * ", "# ", "// ")):
            before = " ".join(f"w{rng.randrange(99)}" for _ in range(rng.randrange(90)))
            lines = textwrap.wrap(text.capitalize(), width) + [f"z{rng.randrange(9)} after"] * rng.randrange(9)
            want[100 * i + j] = label
            docs.append((100 * i + j, "\n".join([before, *(mark + line for line in lines)]), "en", "s", 1))
    path = folder(documents=docs)
    rows = {r["doc_id"]: r for r in L.QUERIES[NAME](spark, path).collect()}
    assert all(label in rows[i]["labels"].split(",") and rows[i]["score"] == 1.0 for i, label in want.items())
    matches(L, NAME, path)


def test_blocks_cover_every_run_of_a_template():
    for n in range(1, 70):
        size = L.span(n)
        assert size >= max(n, 8) and (size == 8 or size < 2 * n)


def test_the_plan_has_no_python_worker_and_no_text_is_joined(spark, folder):
    plan = L.op9_licenses(spark, folder(documents=planted()))._jdf.queryExecution().toString()
    assert "Arrow" not in plan and "Python" not in plan and "text#" not in plan.split("Physical Plan")[1]


def test_empty_table(folder, matches):
    assert matches(L, NAME, folder()) == []
