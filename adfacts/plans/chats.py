"""Queries over agent transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame

from adfacts.operators import transcripts as T
from adfacts.plans import checksql as C
from adfacts.plans.registry import register

_CRITIC = """WHEN name = 'Critic' THEN CASE WHEN contains(content, 'TERMINATE') THEN 'END'
      WHEN contains(content, '@Salary') THEN 'Salary' WHEN contains(content, '@Seniority') THEN 'Seniority'
      WHEN contains(content, '@Arrangement') THEN 'Arrangement' ELSE '{otherwise}' END"""
_AGENT = """WHEN contains(content, '[TASK: Work Arrangement]') THEN 'Arrangement'
      WHEN contains(content, '[TASK: Salary]') THEN 'Salary'
      WHEN contains(content, '[TASK: Seniority]') THEN 'Seniority'"""
_AUDIT = """SELECT conv_id, idx, name, expected AS expected_next, actual AS actual_next,
  expected = actual AS as_expected FROM (SELECT conv_id, idx, name, CASE {rule} ELSE 'END' END AS expected,
  coalesce(lead(name) OVER (PARTITION BY conv_id ORDER BY idx), 'END') AS actual FROM {view})"""


@register(
    "ch1_planned_speaker_audit", "planned_transcripts",
    _AUDIT.format(
        view="planned_transcripts",
        rule="""WHEN idx = 0 THEN 'Planner'
      WHEN name = 'Planner' THEN CASE WHEN contains(content, 'SALARY') THEN 'Salary'
        WHEN contains(content, 'SENIORITY') THEN 'Seniority'
        WHEN contains(content, 'ARRANGEMENT') THEN 'Arrangement' ELSE 'Critic' END
      WHEN name IN ('Salary', 'Seniority', 'Arrangement') THEN 'Critic' """
        + _CRITIC.format(otherwise="Planner"),
    ),
)
def ch1(messages: DataFrame) -> DataFrame:
    return T.speaker_audit(messages, planned=True)


@register(
    "ch2_speaker_audit", "transcripts",
    _AUDIT.format(
        view="transcripts",
        rule=f"""WHEN name = 'User' THEN CASE {_AGENT} ELSE 'END' END
      WHEN name IN ('Salary', 'Seniority', 'Arrangement') THEN 'Critic' """
        + _CRITIC.format(otherwise="END"),
    ),
)
def ch2(messages: DataFrame) -> DataFrame:
    return T.speaker_audit(messages)


@register(
    "ch2_speaker_audit_gappy", "gappy_transcripts",
    _AUDIT.format(
        view="gappy_transcripts",
        rule=f"""WHEN name = 'User' THEN CASE {_AGENT} ELSE 'END' END
      WHEN name IN ('Salary', 'Seniority', 'Arrangement') THEN 'Critic' """
        + _CRITIC.format(otherwise="END"),
    ),
)
def ch2_gappy(messages: DataFrame) -> DataFrame:
    return T.speaker_audit(messages)


FINAL = f"""agents AS (SELECT conv_id, CASE {_AGENT} END AS agent FROM transcripts WHERE idx = 0),
closings AS (SELECT conv_id, max(idx) AS closed FROM transcripts
  WHERE name = 'Critic' AND contains(content, 'TERMINATE') GROUP BY 1),
last_said AS (SELECT conv_id, max(idx) AS idx FROM transcripts JOIN agents USING (conv_id)
  JOIN closings USING (conv_id) WHERE name = agent AND idx < closed GROUP BY 1),
chats AS (SELECT conv_id, max(idx) + 1 AS rounds FROM transcripts GROUP BY 1),
finals AS (SELECT conv_id, rounds, coalesce({C.strip("content")}, 'Unknown') AS answer,
  closed IS NOT NULL AS closed
  FROM chats LEFT JOIN closings USING (conv_id) LEFT JOIN last_said USING (conv_id)
  LEFT JOIN transcripts USING (conv_id, idx))"""


@register("ch3_final_answers", "transcripts", f"WITH {FINAL} SELECT conv_id, answer, closed FROM finals")
def ch3(messages: DataFrame) -> DataFrame:
    return T.final_answers(messages)


@register(
    "ch4_rounds_used", "transcripts",
    f"""WITH {FINAL} SELECT conv_id, rounds, rounds >= 5 AND answer = 'Unknown' AS hit_cap FROM finals""",
)
def ch4(messages: DataFrame) -> DataFrame:
    return T.rounds_used(messages, max_round=5)
