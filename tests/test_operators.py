import math
import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from adfacts.constants import VOTE_LABELS
from adfacts.operators import augment as A
from adfacts.operators import scoring as S
from adfacts.operators import transcripts as T
from adfacts.operators import vectors as V
from adfacts.operators import verify as Y

# --- augmentation ------------------------------------------------------------------------


def test_top_up(spark):
    rows = [(i, f"p{i}", c) for i, c in enumerate("a" * 300 + "b" + "c" * 3 + "d" * 5)]
    df = spark.createDataFrame(rows, "row_id int, prompt string, complete string")
    out = A.top_up(df).collect()
    assert [tuple(r)[:3] for r in out if r["copy"] == 0] == rows
    sizes = pd.Series([r["complete"] for r in out]).value_counts().to_dict()
    assert sizes == {"a": 300, "b": 5, "c": 5, "d": 5}
    copies = sorted((r["complete"], r["copy"], r["row_id"]) for r in out if r["copy"] > 0)
    assert copies == [("b", k, 300) for k in (1, 2, 3, 4)] + [("c", 1, 301), ("c", 2, 302)]
    seeded = A.top_up(df, seed=3, change=F.upper)
    assert seeded.filter("copy > 0 and prompt like 'P%'").count() == 6


def test_header_variants(spark):
    ads = [(4, "Job Title: Cook\nLocation: Town\nHighlights: good\ncontents: rest", "x"),
           (5, "Location: -\ncontents: rest", "y")]
    df = spark.createDataFrame(ads, "ad_id int, prompt string, complete string")
    out = A.header_variants(df, ["E0", "E1", "E2"], ["T0", "T1"], reword=lambda c, v: F.concat(c, F.lit("-"), v))
    got = {(r["ad_id"], r["variant"]): r["prompt"] for r in out.collect()}
    assert got[4, "original"] == ads[0][1]
    assert got[4, "de"] == "Job Title: Cook-de\nEmployer: E2\nLocation: T0\nHighlights: good-de\ncontents: rest"
    assert got[4, "fr"] == "Job Title: Cook-fr\nEmployer: E0\nLocation: T1\nHighlights: good-fr\ncontents: rest"
    assert got[5, "de"] == "Employer: E1\nLocation: -\ncontents: rest"
    assert len(got) == 6


def test_one_synonym(values):
    rows = [("a big Cat, big dog",), ("none here",), (None,), ("CAT",)]
    out = values(lambda c: A.one_synonym(c, {"cat": "lion", "big": "large"}), rows, "t string")
    assert out == ["a large Cat, big dog", "none here", "", "lion"]


def test_label_drift(spark):
    a, b = (spark.createDataFrame([(x,) for x in s], "complete string") for s in ("xxyz", "yyw"))
    assert {tuple(r) for r in A.label_drift(a, b).collect()} == {("x", "train"), ("z", "train"), ("w", "test")}


# --- word vectors ------------------------------------------------------------------------


def test_synonyms_of_a_large_table(spark, monkeypatch):
    rows = [(1, "A big CAT, w7 sat"), (2, "none here"), (3, None), (4, "w99999 first"), (5, ""), (6, "Große katze")]
    df = spark.createDataFrame(rows, "id int, prompt string")
    words = spark.range(100_000).select(F.concat(F.lit("w"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("word"), F.lit("x").alias("synonym"))
    more = spark.createDataFrame([("CAT", "lion"), ("cat", "puma"), ("große", "weite"), ("first", "last")], "word string, synonym string")
    want = {1: "A big lion, w7 sat", 2: "none here", 3: "", 4: "w99999 last", 5: "", 6: "weite katze"}
    for limit in (100, 1_000_000):
        monkeypatch.setattr(A, "SENT_SYNONYMS", limit)
        out = A.first_synonyms(df, words.unionByName(more), "id")
        assert out.columns == df.columns
        assert {r["id"]: r["prompt"] for r in out.collect()} == want


def test_votes_leave_a_row_for_voting_words_only(spark):
    words = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, None), (1, "a"), (None, "a")], "id int, word string")
    votes = spark.createDataFrame([("a", [0.5, 0.0]), ("z", [1.0, 1.0])], "word string, votes array<double>")
    labels = spark.createDataFrame([(0, "x", [1.0])], "label_order int, label string, vector array<double>")
    out = {r["id"]: r["scores"] for r in V.label_scores(words, "id", votes, labels, 2).collect()}
    assert out == {1: [1.0, None], 2: [0.0, None], 3: [0.0, None], None: [0.5, None]}


def test_seniority_vote_matches_a_plain_loop(spark):
    random.seed(2)
    names = sorted({w for label in VOTE_LABELS[:13] for w in label.split()}) + [f"w{i}" for i in range(30)]
    table = {w: [random.gauss(0, 1) for _ in range(3)] for w in names}
    table["zero"] = [0.0, 0.0, 0.0]
    ads = [(i, " ".join(random.choices([*table, "unheard"], k=12)), "<b>", None) for i in range(20)]
    ads += [(20, "unheard of", "", ""), (21, None, None, None)]
    vectors = spark.createDataFrame(list(table.items()), "word string, vector array<double>")
    df = spark.createDataFrame(ads, "id int, job_title string, job_summary string, job_ad_details string")
    del table["apprentice"], table["senior"]
    vectors = spark.createDataFrame(list(table.items()), "word string, vector array<double>")
    means = {}
    for label in VOTE_LABELS:
        found = [table[w] for w in label.split() if w in table]
        if found:
            means[label] = [sum(x) / len(found) for x in zip(*found)]
    assert 3 < len(means) < len(VOTE_LABELS)

    def cosine(a, b):
        return sum(x * y for x, y in zip(a, b)) / (math.hypot(*a) * math.hypot(*b))

    labels = V.label_vectors(vectors)
    votes = V.word_votes(vectors, labels, len(VOTE_LABELS))
    words = V.ad_words(df, "id", "job_title", "job_summary", "job_ad_details")
    scored = V.label_scores(words, "id", votes, labels, len(VOTE_LABELS)).select(
        "id", V.shares(F.col("scores")).alias("shares"), V.winner(F.col("scores"), VOTE_LABELS).alias("label")
    )
    rows = V.by_label(scored, "id", "shares", VOTE_LABELS, "share")
    assert {r["label"] for r in rows.collect()} == set(means)
    out = {r["id"]: r for r in scored.collect()}
    assert set(out) == set(range(22))
    for i, title, *_ in ads:
        scores = dict.fromkeys(means, 0.0)
        for word in (title or "").split():
            if word in table and any(table[word]):
                for label, mean in means.items():
                    similarity = cosine(table[word], mean)
                    if similarity > 0.5:
                        scores[label] += similarity
        total = sum(scores.values())
        shares = [s / total if total else 0.0 for s in scores.values()]
        assert [s for s in out[i]["shares"] if s is not None] == pytest.approx(shares)
        assert out[i]["label"] == max(scores, key=scores.get)
    assert out[21]["label"] == "experienced" and set(out[21]["shares"]) == {0.0, None}


# --- scoring -----------------------------------------------------------------------------


def test_score_batches_and_times(spark):
    def make():
        def answer(prompts):
            time.sleep(0.02)
            return [f"{len(prompts)}:{p}" for p in prompts]

        return answer

    df = spark.range(11).select("id", F.col("id").cast("string").alias("prompt")).coalesce(1)
    out = {r["id"]: r for r in S.score(df, make, batch_size=4).collect()}
    assert [out[i]["y_pred"] for i in (0, 3, 10)] == ["4:0", "4:3", "3:10"]
    assert out[0]["inference_time"] == out[3]["inference_time"] >= 0.005
    assert S.score(df.limit(0), make).columns == ["id", "prompt", "y_pred", "inference_time"]


def test_calls_are_retried_then_marked(spark):
    def make():
        tries = {}

        def call(prompt):
            tries[prompt] = tries.get(prompt, 0) + 1
            if prompt == "never" or tries[prompt] < 3:
                raise TimeoutError
            return f" ok {tries[prompt]} "

        return call

    df = spark.createDataFrame([("m", "never"), ("m", "third")], "model string, prompt string")
    called = S.score_calls(df, make, delay=0.0, sentinel="NO").cache()
    out = {r["prompt"]: (r["y_pred"], r["inference_time"]) for r in called.collect()}
    assert out["never"] == ("NO", 0.0) and out["third"][0] == "ok 3"
    (rate,) = S.sentinel_rate(called, "model", "NO").collect()
    assert tuple(rate) == ("m", 2, 1, 0.5)


def test_latency_summary_like_describe(spark):
    random.seed(4)
    rows = [(random.choice("aab"), random.choice([0.5, 0.7, random.random()])) for _ in range(999)]
    rows += [("one", 3.0), ("none", None), ("a", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    out = {r["g"]: r for r in S.latency_summary(df, "v", ["g"]).collect()}
    frame = pd.DataFrame(rows, columns=["g", "v"]).dropna()
    assert set(out) == {"a", "b", "one"}
    for g, values in frame.groupby("g")["v"]:
        d = values.describe()
        got = [out[g][c] for c in ("count", "mean", "min", "p25", "p50", "p75", "max")]
        assert got == pytest.approx([d[c] for c in ("count", "mean", "min", "25%", "50%", "75%", "max")])
    assert out["one"]["std"] is None


def test_candidate_filters(spark):
    random.seed(6)
    rows = [(g, i, random.random()) for g, n in (("hot", 400), ("few", 3), ("one", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, item int, s double")
    soft = S.softmax(df, "g", "item", "s", banned=[1], temperature=0.5).cache()
    top = S.top_k(soft, "g", "item", 20).drop("place").cache()
    cut = S.nucleus(top, "g", "item", 0.5)
    for g in ("hot", "few", "one"):
        kept = [(i, s) for gg, i, s in rows if gg == g and i != 1]
        e = {i: math.exp(s / 0.5) for i, s in kept}
        prob = {i: x / sum(e.values()) for i, x in e.items()}
        got = {r["item"]: r["prob"] for r in soft.filter(F.col("g") == g).collect()}
        assert got == pytest.approx(prob)
        best = sorted(prob, key=lambda i: (-prob[i], i))[:20]
        share = {i: prob[i] / sum(prob[j] for j in best) for i in best}
        assert {r["item"]: r["prob"] for r in top.filter(F.col("g") == g).collect()} == pytest.approx(share)
        stay, total = [], 0.0
        for i in best:
            if total <= 0.5:
                stay.append(i)
            total += share[i]
        got = {r["item"]: r["prob"] for r in cut.filter(F.col("g") == g).collect()}
        assert got == pytest.approx({i: share[i] / sum(share[j] for j in stay) for i in stay})
        assert len(got) >= 1


# --- verification ---------------------------------------------------------------------------


def test_first_valid(spark):
    good, bad = "1-2-AUD-DAILY", "2-1-AUD-DAILY"
    rows = [(1, k, "Salary", good if k >= 3 else bad) for k in range(1, 7)]
    rows += [(2, k, "Salary", good if k == 6 else bad) for k in range(1, 7)]
    rows += [(3, k, "Salary", None if k == 1 else good) for k in range(1, 7)]
    rows += [(4, k, "default", f"raw {k}") for k in range(1, 7)]
    rows += [(5, 1, "Seniority", "a Lead role"), (6, 1, "Salary", "")]
    df = spark.createDataFrame(rows, "prompt_id int, attempt int, task_type string, raw string")
    out = {r["prompt_id"]: tuple(r)[1:] for r in Y.first_valid(Y.checked(df)).collect()}
    # An attempt that raised is a failure; an empty answer cleans to "no salary", which is valid.
    assert out == {
        1: (good, True, 2), 2: (good, False, 5), 3: (good, True, 1), 6: ("0-0-None-None", True, 0),
        4: ("raw 6", False, 5), 5: ("lead", True, 0),
    }


def test_attempt_until_valid_asks_only_what_is_open(spark):
    def answerer_for(attempt):
        def make():
            return lambda prompts: [
                "Output: remote" if int(p.split()[-1]) <= attempt else "?" for p in prompts
            ]

        return make

    rows = [(i, f"[TASK: Work Arrangement] {i}") for i in (1, 2, 7)]
    df = spark.createDataFrame(rows, "prompt_id int, prompt string")
    attempts = Y.attempt_until_valid(df, answerer_for, mode="chain")
    counts = {r["prompt_id"]: r["count"] for r in attempts.groupBy("prompt_id").count().collect()}
    assert counts == {1: 1, 2: 2, 7: 6}
    out = {r["prompt_id"]: tuple(r)[1:] for r in Y.first_valid(attempts).collect()}
    assert out == {1: ("Remote", True, 0), 2: ("Remote", True, 1), 7: ("Unknown", False, 5)}
    assert Y.total_re_attempts(Y.first_valid(attempts)).collect()[0][0] == 6


def test_a_call_that_raises_is_a_failed_attempt(spark):
    def answerer_for(attempt):
        def make():
            def answer(prompts):
                if attempt < 3:
                    raise ConnectionError
                return ["remote"] * len(prompts)

            return answer

        return make

    df = spark.createDataFrame([(1, "[TASK: Work Arrangement] 1")], "prompt_id int, prompt string")
    attempts = Y.attempt_until_valid(df, answerer_for)
    assert [tuple(r)[1:] for r in Y.first_valid(attempts).collect()] == [("Remote", True, 2)]


def test_a_batch_needs_an_answer_per_prompt(spark):
    df = spark.range(4).select("id", F.lit("p").alias("prompt")).coalesce(1)
    with pytest.raises(Exception, match="3 answers to 4 prompts"):
        S.score(df, lambda: lambda prompts: ["x"] * 3, batch_size=4).collect()


# --- transcripts ----------------------------------------------------------------------------


def chat(conv, *messages):
    return [(conv, i, name, content) for i, (name, content) in enumerate(messages)]


def test_final_answers_and_rounds(spark):
    rows = chat(1, ("User", "[TASK: Salary]"), ("Salary", " one "), ("Critic", "@Salary"),
                ("Salary", " two "), ("Critic", "ok TERMINATE"), ("Salary", "late"))
    rows += chat(2, ("User", "[TASK: Salary]"), ("Seniority", "wrong agent"), ("Critic", "TERMINATE"))
    rows += chat(3, ("User", "no task"), ("Salary", "x"), ("Critic", "TERMINATE"))
    rows += chat(4, ("User", "[TASK: Work Arrangement] [TASK: Salary]"), ("Arrangement", "Remote"),
                 ("Critic", "TERMINATE"), ("Arrangement", "Hybrid"), ("Critic", "TERMINATE"))
    rows += chat(5, *[("User", "[TASK: Salary]")] + [("Salary", "x"), ("Critic", "unclear")] * 2)
    df = spark.createDataFrame(rows, "conv_id int, idx int, name string, content string")
    out = {r["conv_id"]: r["answer"] for r in T.final_answers(df).collect()}
    assert out == {1: "two", 2: "Unknown", 3: "Unknown", 4: "Hybrid", 5: "Unknown"}
    rounds = {r["conv_id"]: (r["rounds"], r["hit_cap"]) for r in T.rounds_used(df, 5).collect()}
    assert rounds == {1: (6, False), 2: (3, False), 3: (3, False), 4: (5, False), 5: (5, True)}


def test_speaker_audit(spark):
    rows = chat(1, ("User", "[TASK: Seniority]"), ("Seniority", "x"), ("Critic", "unclear"), ("Salary", None))
    rows += chat(2, ("User", "hello"))
    rows += [(3, 0, "User", "[TASK: Salary]"), (3, 2, "Salary", "x"), (3, 7, "Critic", "TERMINATE")]
    df = spark.createDataFrame(rows, "conv_id int, idx int, name string, content string")
    out = {(r["conv_id"], r["idx"]): (r["expected_next"], r["actual_next"]) for r in T.speaker_audit(df).collect()}
    assert out == {(1, 0): ("Seniority", "Seniority"), (1, 1): ("Critic", "Critic"), (1, 2): ("END", "Salary"),
                   (1, 3): ("Critic", "END"), (2, 0): ("END", "END"),
                   (3, 0): ("Salary", "Salary"), (3, 2): ("Critic", "Critic"), (3, 7): ("END", "END")}
    rows = chat(1, ("Planner", "[TASK: Salary]"), ("Planner", "no idea"), ("Critic", "unclear"),
                ("Planner", "SENIORITY and ARRANGEMENT"), ("Seniority", "x"), ("Critic", "TERMINATE @Salary"))
    df = spark.createDataFrame(rows, "conv_id int, idx int, name string, content string")
    audit = T.speaker_audit(df, planned=True)
    assert [r["expected_next"] for r in audit.orderBy("idx").collect()] == [
        "Planner", "Critic", "Planner", "Seniority", "Critic", "END",
    ]
    assert audit.filter("as_expected").count() == 6
