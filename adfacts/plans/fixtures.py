"""Tables of the shapes the operators read, derived from the given tables.

Each view is one SQL text that both engines read the same way. ``{name}`` stands for a
given table; ``{one_to_six}`` for the engine's own way to repeat a row six times.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession

from adfacts.constants import VOTE_LABELS
from adfacts.session import spread_out

# A label of one word that no other label has; the sparse vectors lack it.
ABSENT_LABEL = next(
    label for label in VOTE_LABELS if sum(label in other.split() for other in VOTE_LABELS) == 1
)
VOTE_WORDS = sorted({word for label in VOTE_LABELS for word in label.split()})


def _word(number: str) -> str:
    """The word with this number: the first few are the words of the labels."""
    cases = " ".join(f"WHEN {i} THEN '{word}'" for i, word in enumerate(VOTE_WORDS))
    return f"CASE {number} {cases} ELSE concat('word', cast({number} AS string)) END"


VIEWS = {
    "ads": """
SELECT
  o_orderkey AS ad_id,
  CASE o_orderkey % 9 WHEN 0 THEN 'AUS' WHEN 1 THEN 'SG' WHEN 2 THEN 'HK' WHEN 3 THEN 'ID'
    WHEN 4 THEN 'TH' WHEN 5 THEN 'NZ' WHEN 6 THEN 'MY' WHEN 7 THEN 'PH' ELSE 'XX' END AS nation_short_desc,
  CASE o_orderkey % 8 WHEN 0 THEN 'Senior Clerk' WHEN 1 THEN 'Graduate Analyst 😀' WHEN 2 THEN 'Team Lead'
    WHEN 3 THEN 'Junior Cook' WHEN 4 THEN 'Entry Level Nurse' WHEN 5 THEN ' Director ' WHEN 6 THEN NULL
    ELSE 'Clerk 🚀🚀' END AS job_title,
  concat('Order ', o_orderpriority) AS job_summary,
  concat('<p>',
    CASE o_orderkey % 6 WHEN 0 THEN 'Remote role, some days on-site' WHEN 1 THEN 'Hybrid team' WHEN 2 THEN 'WFH ok'
      WHEN 3 THEN 'in person' WHEN 4 THEN 'flexible hours' ELSE 'support desk' END,
    '</p><div>Pay &amp; perks<br>weekly <b>bonus</b></div>',
    CASE o_orderkey % 5
      WHEN 0 THEN concat('<h3>Compensation</h3><p>', cast(o_orderkey % 90 + 10 AS string), ',000 per month</p>')
      WHEN 1 THEN concat('<h3>Compensation Range</h3><p>', cast(o_orderkey % 50 + 40 AS string), ',500 to ',
                         cast(o_orderkey % 50 + 10 AS string), ',250</p>')
      WHEN 2 THEN '<h3>Compensation Range</h3><p>negotiable</p>'
      WHEN 3 THEN concat('<h3>Compensation</h3><p>', cast(o_orderkey % 700 + 300 AS string), '</p>')
      ELSE '<p>paid per hour</p>' END) AS job_ad_details,
  CASE o_orderkey % 7 WHEN 0 THEN NULL
    WHEN 1 THEN concat('$', cast(cast(floor(o_totalprice / 100) AS bigint) AS string), ' per year')
    WHEN 2 THEN concat('$', cast(o_orderkey % 40 + 20 AS string), '.5 - $', cast(o_orderkey % 40 + 30 AS string), '.5 per hour')
    WHEN 3 THEN concat(cast(cast(floor(o_totalprice / 1000) AS bigint) AS string), ',000 p.m. plus 10% bonus')
    WHEN 4 THEN 'competitive' WHEN 5 THEN '5 days per week' ELSE '1,200 - 1,800 monthly' END AS salary_additional_text,
  o_orderpriority AS classification_name,
  o_orderstatus AS subclassification_name,
  CASE WHEN o_orderkey % 7 = 6 AND o_orderkey % 9 = 0 THEN '1200-1800-AUD-MONTHLY'
    WHEN o_orderkey % 7 = 6 THEN '1200-1800-SGD-MONTHLY' ELSE ' 0-0-None-None ' END AS y_true,
  CASE o_orderkey % 3 WHEN 0 THEN 'Hybrid' WHEN 1 THEN 'Onsite' ELSE 'Remote' END AS arrangement_true
FROM {orders}
""",
    "predictions": """
SELECT
  o_orderkey AS row_id,
  CASE o_orderkey % 2 WHEN 0 THEN 'model_a' ELSE 'model_b' END AS model,
  CASE o_orderkey % 7 WHEN 0 THEN '[TASK: Seniority] Extract seniority level from the job ad.'
    WHEN 1 THEN '[TASK: Work Arrangement] Extract work arrangement from the job ad.'
    WHEN 2 THEN 'no task marker'
    ELSE '[TASK: Salary] Extract salary information from the job ad.' END AS prompt,
  CASE o_orderkey % 7 WHEN 0 THEN CASE o_custkey % 3 WHEN 0 THEN 'senior' WHEN 1 THEN 'entry level' ELSE 'lead' END
    WHEN 1 THEN CASE o_custkey % 3 WHEN 0 THEN 'Remote' WHEN 1 THEN 'Hybrid' ELSE 'OnSite' END
    WHEN 2 THEN 'other'
    ELSE CASE WHEN o_custkey % 5 = 0 THEN '0-0-None-None'
      ELSE concat(cast(o_custkey % 90 + 10 AS string), '00-', cast(o_custkey % 90 + 20 AS string), '00-AUD-MONTHLY') END
    END AS complete,
  CASE o_orderkey % 7 WHEN 0 THEN CASE o_orderkey % 4 WHEN 0 THEN 'senior' WHEN 1 THEN 'Entry and mid level' ELSE 'lead' END
    WHEN 1 THEN CASE o_orderkey % 4 WHEN 0 THEN 'remote.' WHEN 1 THEN 'Hybrid' ELSE 'OnSite' END
    WHEN 2 THEN 'other'
    ELSE CASE o_orderkey % 6 WHEN 0 THEN 'The pay is good'
      WHEN 1 THEN concat(cast(o_custkey % 90 + 10 AS string), '00-', cast(o_custkey % 90 + 25 AS string), '00-AUD-MONTHLY')
      WHEN 2 THEN '32-45-AUD-HOURLY'
      WHEN 3 THEN concat('Output: ', cast(o_custkey % 90 + 10 AS string), '00-', cast(o_custkey % 90 + 20 AS string), '00-AUD-MONTHLY ok')
      WHEN 4 THEN 'a-b-c-d-e'
      ELSE concat(cast(o_custkey % 90 + 10 AS string), '00-', cast(o_custkey % 90 + 20 AS string), '00-AUD-MONTHLY') END
    END AS y_pred
FROM {orders}
""",
    "gappy_predictions": """
SELECT row_id,
  CASE WHEN row_id % 5 = 0 THEN NULL WHEN row_id % 5 = 1 THEN 'model_n' ELSE model END AS model,
  prompt,
  CASE WHEN row_id % 5 = 1 THEN NULL ELSE complete END AS complete,
  CASE WHEN row_id % 5 = 1 THEN NULL ELSE y_pred END AS y_pred
FROM {predictions}
""",
    "seniority_ads": """
SELECT o_orderkey AS ad_id,
  CASE o_orderkey % 6 WHEN 0 THEN '<b>Senior</b> Clerk' WHEN 1 THEN 'Graduate Analyst' WHEN 2 THEN 'Team Lead'
    WHEN 3 THEN 'Junior Cook' WHEN 4 THEN NULL ELSE 'Clerk' END AS job_title,
  CASE o_orderkey % 4 WHEN 0 THEN concat('<p>Word', cast(o_custkey % 500 AS string), '</p>') WHEN 1 THEN NULL
    ELSE concat('word', cast(o_custkey % 900 AS string), ' as director') END AS job_summary,
  CASE o_orderkey % 3 WHEN 0 THEN 'senior' WHEN 1 THEN 'graduate' ELSE 'director' END AS y_true
FROM {orders}
""",
    "gappy_transcripts": """
SELECT conv_id, cast(turn * turn + turn AS int) AS idx,
  CASE WHEN turn = 0 THEN 'User' WHEN turn % 2 = 0 THEN 'Critic'
    ELSE CASE conv_id % 3 WHEN 0 THEN 'Salary' WHEN 1 THEN 'Seniority' ELSE 'Arrangement' END END AS name,
  CASE WHEN turn = 0 THEN '[TASK: Salary] ad'
    WHEN turn % 2 = 0 THEN CASE (conv_id + turn) % 3 WHEN 0 THEN '@Salary' WHEN 1 THEN 'unclear' ELSE 'TERMINATE' END
    ELSE text END AS content
FROM {conversations}
""",
    "rare_rows": """
SELECT p_partkey AS row_id, p_name AS prompt,
  concat(p_type, ' ', p_brand, ' ', cast(p_size AS string)) AS complete FROM {part}
""",
    "attempts": """
SELECT o.o_orderkey AS prompt_id, o.attempt,
  CASE o.o_orderkey % 3 WHEN 0 THEN 'Salary' WHEN 1 THEN 'Seniority' ELSE 'Work Arrangement' END AS task_type,
  CASE WHEN (o.o_orderkey * 5 + o.attempt) % 13 = 0 THEN NULL
    WHEN o.attempt < 1 + o.o_orderkey % 8 THEN
      CASE (o.o_orderkey + o.attempt) % 4 WHEN 0 THEN 'I think so' WHEN 1 THEN 'x'
        WHEN 2 THEN '900-100-AUD-MONTHLY' ELSE '100-900-EUR-MONTHLY' END
    ELSE CASE o.o_orderkey % 3 WHEN 0 THEN 'Output: 100-900-AUD-MONTHLY done'
        WHEN 1 THEN 'Output: Senior' ELSE 'Output: work is HYBRID' END END AS raw
FROM (SELECT o_orderkey, {one_to_six} AS attempt FROM {orders}) o
""",
    "transcripts": """
SELECT conv_id, turn AS idx,
  CASE WHEN turn = 0 THEN 'User' WHEN turn % 2 = 0 THEN 'Critic'
    ELSE CASE conv_id % 3 WHEN 0 THEN 'Salary' WHEN 1 THEN 'Seniority' ELSE 'Arrangement' END END AS name,
  CASE WHEN turn = 0 THEN
      CASE conv_id % 3 WHEN 0 THEN '[TASK: Salary] ad' WHEN 1 THEN '[TASK: Seniority] ad' ELSE '[TASK: Work Arrangement] ad' END
    WHEN turn % 2 = 0 THEN
      CASE (conv_id + turn) % 4 WHEN 0 THEN '@Salary' WHEN 1 THEN 'unclear' WHEN 2 THEN '@Arrangement' ELSE 'TERMINATE' END
    ELSE concat(' ', text, ' ') END AS content
FROM {conversations}
""",
    "planned_transcripts": """
SELECT conv_id, turn AS idx,
  CASE turn % 4 WHEN 0 THEN 'Planner' WHEN 1 THEN CASE WHEN conv_id % 5 = 0 THEN 'Critic' ELSE 'Planner' END
    WHEN 2 THEN CASE conv_id % 3 WHEN 0 THEN 'Salary' WHEN 1 THEN 'Seniority' ELSE 'Arrangement' END
    ELSE 'Critic' END AS name,
  CASE WHEN turn = 0 THEN concat('[TASK: Salary] ', text)
    WHEN turn % 4 = 3 THEN
      CASE (conv_id + turn) % 4 WHEN 0 THEN '@Salary' WHEN 1 THEN 'unclear' WHEN 2 THEN '@Seniority' ELSE 'TERMINATE' END
    WHEN turn % 4 = 2 THEN text
    ELSE CASE conv_id % 4 WHEN 0 THEN 'a SALARY task' WHEN 1 THEN 'SENIORITY' WHEN 2 THEN 'ARRANGEMENT' ELSE 'no idea' END
    END AS content
FROM {conversations}
""",
    "pairs": """
SELECT u.conv_id * 100 + u.turn AS pair_id, u.conv_id, u.text AS prompt, a.text AS complete
FROM {conversations} u JOIN {conversations} a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user' AND a.role = 'assistant'
""",
    "header_ads": """
SELECT p_partkey AS ad_id,
  concat('Job Title: ', p_name, chr(10), 'noise line', chr(10), 'abstract : ', p_type, chr(10),
    CASE p_partkey % 3 WHEN 0 THEN concat('Location: -', chr(10)) WHEN 1 THEN concat('Location: Town ', cast(p_size AS string), chr(10)) ELSE '' END,
    CASE WHEN p_partkey % 4 = 0 THEN '' ELSE concat('Contents: ', p_brand, chr(10), 'Location: inside tail') END) AS prompt,
  p_brand AS complete
FROM {part}
""",
    "label_rows": """
SELECT s_suppkey AS row_id, s_name AS prompt, concat('class ', cast(s_nationkey AS string)) AS complete FROM {supplier}
""",
    "train_labels": """
SELECT s_suppkey AS row_id, concat('class ', cast(s_nationkey AS string)) AS complete FROM {supplier} WHERE s_acctbal >= 5000
""",
    "test_labels": """
SELECT s_suppkey AS row_id, concat('class ', cast(s_nationkey AS string)) AS complete FROM {supplier} WHERE s_acctbal < 5000
""",
    "corpus": """
SELECT doc_id, text AS prompt,
  CASE doc_id % 3 WHEN 0 THEN 'onsite' WHEN 1 THEN 'REMOTE' ELSE 'Hybrid' END AS complete,
  CASE WHEN doc_id % 4 = 0 THEN 'work_arrangement' ELSE 'salary' END AS task_type
FROM {documents}
""",
    "word_vectors": f"""
SELECT {_word("vec_id")} AS word, embedding AS vector FROM {{embeddings}}
""",
    "sparse_word_vectors": f"""
SELECT {_word("vec_id")} AS word, embedding AS vector FROM {{embeddings}}
WHERE vec_id <> {VOTE_WORDS.index(ABSENT_LABEL)}
""",
    "doc_words": f"""
SELECT l_orderkey AS doc_id, {_word("l_partkey")} AS word FROM {{lineitem}}
""",
    # One element of each vector stands in for the score a model gives.
    "candidates": """
SELECT label, vec_id, cast(embedding[{first}] AS double) * 10 AS score FROM {embeddings}
""",
    "synonyms": """
SELECT DISTINCT lower(word) AS word, concat('like ', lower(word)) AS synonym FROM (
  SELECT regexp_extract(p_name, '([A-Za-z]+)$', 1) AS word FROM {part}
  UNION ALL SELECT p_type AS word FROM {part} WHERE p_partkey % 3 <> 0) w
WHERE word <> ''
""",
    "timed_events": """
SELECT event_id, CASE WHEN event_id % 50 = 1 THEN NULL WHEN event_id % 3 = 0 THEN 1 ELSE user_id END AS user_id,
  event_type, value, {micros} AS at_us
FROM {events}
""",
    "label_history": """
SELECT user_id AS ad_id, at_us AS valid_from, event_type AS label, event_id AS version
FROM {timed_events} WHERE event_id % 4 = 1
""",
    "timed_answers": """
SELECT event_id AS answer_id, user_id AS ad_id, at_us AS answered_at FROM {timed_events} WHERE event_id % 4 <> 1
""",
    "hourly_values": """
SELECT user_id, cast(floor(at_us / 3600000000) AS bigint) AS hour, count(*) AS n,
  max(CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END) AS value
FROM {timed_events} GROUP BY 1, 2
""",
    "salary_ranges": """
SELECT o_orderkey AS ad_id, cast(floor(o_totalprice / 10) AS bigint) AS low,
  CASE WHEN o_orderkey % 60 = 7 THEN NULL
    ELSE cast(floor(o_totalprice / 10) AS bigint) + o_custkey % 40 - 2 END AS high
FROM {orders}
""",
    "pay_bands": """
SELECT p_partkey AS band, (p_partkey * 37) % 50000 AS band_low,
  (p_partkey * 37) % 50000 + CASE WHEN p_partkey % 100 = 3 THEN 5000 ELSE p_size END AS band_high
FROM {part}
""",
    "visits": """
SELECT event_id, user_id, event_type, at_us AS begins,
  at_us + cast(floor(value * 60000000) AS bigint) AS ends FROM {timed_events} WHERE event_id % 4 < 2
""",
    "ads_before": """
SELECT o_orderkey AS ad_id, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderstatus END AS status, o_totalprice AS pay
FROM {orders}
UNION ALL SELECT o_orderkey, 'twice', 1.5 FROM {orders} WHERE o_orderkey % 301 = 0
UNION ALL SELECT o_orderkey, 'twice', 1.5 FROM {orders} WHERE o_orderkey % 301 = 0
""",
    "ads_after": """
SELECT o_orderkey + CASE WHEN o_orderkey % 397 = 5 THEN 100000000 ELSE 0 END AS ad_id,
  CASE WHEN o_orderkey % 11 = 0 AND o_orderkey % 407 <> 0 THEN NULL ELSE o_orderstatus END AS status,
  o_totalprice + CASE WHEN o_orderkey % 503 = 9 THEN 1 ELSE 0 END AS pay
FROM {orders} WHERE o_orderkey % 601 <> 3
UNION ALL SELECT o_orderkey, 'twice', 1.5 FROM {orders} WHERE o_orderkey % 301 = 0
""",
    "timed_predictions": """
SELECT *, cast(row_id * 31 % 977 AS double) / 8 AS inference_time FROM {predictions}
""",
    "kept_predictions": """
SELECT * FROM {timed_predictions} WHERE row_id % 4 IN (0, 2) OR row_id % 8 = 1
""",
    "quality": """
SELECT doc_id, cast(quality AS string) AS complete, cast(toxic AS string) AS y_pred FROM {labels}
""",
}

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

SPARK_WORDS = {
    "one_to_six": "explode(sequence(1L, 6L))", "first": "0",
    # Times have no zone in the files.
    "micros": "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)",
}
DUCK_WORDS = {"one_to_six": "unnest(generate_series(1, 6))", "first": "1", "micros": "epoch_us(ts)"}


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread_out(df) if spread else df


def _used(text: str) -> set[str]:
    return {field for _, field, _, _ in string.Formatter().parse(text) if field}


def view(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """A derived view, or a given table, as a DataFrame."""
    if name in TABLES:
        return table(spark, sf_dir, name, spread)
    text = VIEWS[name]
    tables = {
        t: view(spark, sf_dir, t, spread) for t in _used(text) if t in TABLES or t in VIEWS
    }
    words = {k: v for k, v in SPARK_WORDS.items() if k in _used(text)}
    for word, value in words.items():
        text = text.replace("{" + word + "}", value)
    return spark.sql(text, **tables)


def with_views(names: str, body: str) -> str:
    """``body`` behind the derived views it reads, as SQL for the checking engine."""
    ctes: dict[str, str] = {}

    def add(name: str) -> None:
        text = VIEWS[name]
        values = {t: t for t in (*TABLES, *VIEWS)} | DUCK_WORDS
        for word in _used(text):
            if word in VIEWS:
                add(word)
            text = text.replace("{" + word + "}", values[word])
        ctes[name] = f"{name} AS ({text.strip()})"

    for name in names.split():
        if name in VIEWS:
            add(name)
    ctes_text = ",\n".join(ctes.values())
    if not ctes:
        return body
    if body.lstrip().upper().startswith("WITH "):
        return f"WITH {ctes_text},\n{body.lstrip()[5:]}"
    return f"WITH {ctes_text}\n{body}"
