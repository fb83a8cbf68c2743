"""Queries over the cleaning and prompt functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adfacts import constants as K
from adfacts.functions import text as T
from adfacts.functions.answers import same
from adfacts.operators import pairs as P
from adfacts.plans import checksql as C
from adfacts.plans.registry import register


@register(
    "pf1_labelled_pairs", "ads",
    f"""SELECT ad_id, {C.html_to_text(C.strip("job_ad_details"))} AS prompt,
  {C.strip("y_true")} AS complete FROM ads""",
    heavy=True,
)
def pf1(ads: DataFrame) -> DataFrame:
    return P.labelled(ads, "ad_id", prompt=T.arrangement_prompt(F.col("job_ad_details")))


@register(
    "pf2_both_sides", "header_ads",
    "SELECT ad_id, prompt, complete FROM (SELECT ad_id, prompt, "
    "CASE WHEN contains(prompt, 'Location: -') THEN '' ELSE complete END AS complete FROM header_ads) "
    "WHERE length(prompt) > 0 AND length(complete) > 0",
)
def pf2(ads: DataFrame) -> DataFrame:
    emptied = F.when(F.contains("prompt", F.lit("Location: -")), "").otherwise(F.col("complete"))
    return P.both_sides(ads.withColumn("complete", emptied))


@register(
    "pf3_as_text", "ads",
    "SELECT ad_id, coalesce(salary_additional_text, '') AS prompt, "
    "cast(length(job_summary) AS VARCHAR) AS complete FROM ads",
)
def pf3(ads: DataFrame) -> DataFrame:
    return P.as_text(
        ads.select(
            "ad_id",
            F.col("salary_additional_text").alias("prompt"),
            F.length("job_summary").alias("complete"),
        )
    )


@register(
    "pf4_task_type", "predictions",
    f"""SELECT row_id, {C.task_type("prompt")} AS task_type,
  {C.task_type("prompt", "default")} AS task_or_default FROM predictions""",
)
def pf4(predictions: DataFrame) -> DataFrame:
    prompt = F.col("prompt")
    return predictions.select(
        "row_id",
        T.task_type(prompt).alias("task_type"),
        T.task_type(prompt, "default").alias("task_or_default"),
    )


@register(
    "pf5_section", "predictions",
    f"SELECT row_id, complete, y_pred FROM predictions WHERE {C.task_type('prompt')} = 'Seniority'",
)
def pf5(predictions: DataFrame) -> DataFrame:
    return P.section(predictions, "Seniority").select("row_id", "complete", "y_pred")


@register(
    "pf5_section_by_position", "predictions",
    "SELECT row_id, complete FROM predictions WHERE row_id >= 567 AND row_id < 1256",
)
def pf5_rows(predictions: DataFrame) -> DataFrame:
    return P.rows_between(predictions, 567, 1256).select("row_id", "complete")


@register(
    "pf6_preview", "predictions",
    f"""WITH t AS (SELECT row_id, complete, {C.task_type("prompt")} AS task_type FROM predictions),
r AS (SELECT *, row_number() OVER (PARTITION BY task_type ORDER BY row_id)::INTEGER AS place FROM t)
SELECT row_id, task_type, complete, place FROM r WHERE place <= 10""",
)
def pf6(predictions: DataFrame) -> DataFrame:
    return P.preview(predictions, 10).select("row_id", "task_type", "complete", "place")


@register(
    "pf7_first_rows", "predictions",
    " UNION ALL ".join(
        f"SELECT {C.quoted(task)} AS task, min(row_id) AS first_row FROM predictions "
        f"WHERE contains(prompt, {C.quoted(marker)})"
        for task, marker in K.TASK_MARKERS.items()
    ),
)
def pf7(predictions: DataFrame) -> DataFrame:
    return P.first_rows(predictions)


@register(
    "pf10_correct_flag", "predictions",
    "SELECT row_id, coalesce(complete = y_pred, false) AS val FROM predictions",
)
def pf10(predictions: DataFrame) -> DataFrame:
    return predictions.select("row_id", same(F.col("complete"), F.col("y_pred")).alias("val"))


@register("tx1_html_to_text", "pages", f"SELECT page_id, {C.html_to_text('html')} AS text FROM pages", heavy=True)
def tx1(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", T.html_to_text(F.col("html")).alias("text"))


@register("tx2_remove_emojis", "ads", f"SELECT ad_id, {C.no_emojis('job_title')} AS title FROM ads")
def tx2(ads: DataFrame) -> DataFrame:
    return ads.select("ad_id", T.remove_emojis(F.col("job_title")).alias("title"))


CLEANED = f"""cleaned AS (SELECT *,
  {C.no_emojis(C.html_to_text(C.strip("coalesce(job_title, '')")))} AS title,
  {C.html_to_text(C.strip("coalesce(job_ad_details, '')"))} AS ad FROM ads)"""


@register("tx3_clean_title_and_ad", "ads", f"WITH {CLEANED} SELECT ad_id, title, ad FROM cleaned", heavy=True)
def tx3(ads: DataFrame) -> DataFrame:
    return ads.select(
        "ad_id",
        T.clean_title(F.col("job_title")).alias("title"),
        T.clean_ad(F.col("job_ad_details")).alias("ad"),
    )


_PAY = C.strip("coalesce(salary_additional_text, '')")
_SALARY = f"title || ' ' || ad || ' ' || {C.strip('nation_short_desc')} || ' ' || {_PAY}"


@register(
    "tx4_salary_prompt", "ads",
    f"""WITH {CLEANED}, whole AS (SELECT ad_id, {_SALARY} AS w FROM cleaned)
SELECT ad_id, {C.html_to_text("w")} AS prompt FROM whole""",
    heavy=True,
)
def tx4(ads: DataFrame) -> DataFrame:
    prompt = T.salary_prompt(
        F.col("job_title"), F.col("job_ad_details"), F.col("nation_short_desc"),
        F.col("salary_additional_text"),
    )
    return ads.select("ad_id", prompt.alias("prompt"))


_SENIORITY = (
    f"title || ' ' || {C.strip('job_summary')} || ' ' || ad || ' ' || "
    f"{C.strip('classification_name')} || ' ' || {C.strip('subclassification_name')}"
)


@register(
    "tx5_seniority_prompt", "ads",
    f"""WITH {CLEANED}, whole AS (SELECT ad_id, {_SENIORITY} AS w FROM cleaned)
SELECT ad_id, {C.html_to_text("w")} AS prompt FROM whole""",
    heavy=True,
)
def tx5(ads: DataFrame) -> DataFrame:
    prompt = T.seniority_prompt(
        F.col("job_title"), F.col("job_summary"), F.col("job_ad_details"),
        F.col("classification_name"), F.col("subclassification_name"),
    )
    return ads.select("ad_id", prompt.alias("prompt"))


@register(
    "tx6_arrangement_prompt", "pages",
    f"SELECT page_id, {C.html_to_text(C.strip('html'))} AS prompt FROM pages",
    heavy=True,
)
def tx6(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", T.arrangement_prompt(F.col("html")).alias("prompt"))


@register(
    "tx7_strip_tags", "pages",
    f"""SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'),
  {C.quoted(T.WHITE_SPACE_RUN)}, ' ', 'g'), ' ') AS text FROM pages""",
)
def tx7(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", T.strip_tags(F.col("html")).alias("text"))


@register(
    "tx8_joined_text", "ads",
    "SELECT ad_id, coalesce(job_title, '') || ' ' || coalesce(job_summary, '') || ' ' || "
    "coalesce(job_ad_details, '') AS text FROM ads",
)
def tx8(ads: DataFrame) -> DataFrame:
    parts = [F.col(c) for c in ("job_title", "job_summary", "job_ad_details")]
    return ads.select("ad_id", T.joined_text(*parts).alias("text"))


@register(
    "tx9_lowered", "ads",
    "SELECT ad_id, lower(job_ad_details) AS ad, lower(coalesce(salary_additional_text, '')) AS pay FROM ads",
)
def tx9(ads: DataFrame) -> DataFrame:
    return ads.select(
        "ad_id",
        T.lowered(F.col("job_ad_details")).alias("ad"),
        T.lowered(F.col("salary_additional_text")).alias("pay"),
    )


def _by_task(body) -> str:
    return ", ".join(f"{body(task)} AS {task}" for task in K.TAGGED_PREFIX)


@register(
    "tx10_tagged_prompt", "ads",
    "SELECT ad_id, "
    + _by_task(
        lambda t: f"{C.quoted(K.TAGGED_PREFIX[t])} || 'job ad: ' || chr(10) || "
        "job_ad_details || chr(10) || chr(10)",
    )
    + " FROM ads",
)
def tx10(ads: DataFrame) -> DataFrame:
    ad = F.col("job_ad_details")
    return ads.select("ad_id", *[T.tagged_prompt(ad, t).alias(t) for t in K.TAGGED_PREFIX])


@register(
    "tx11_zero_shot_prompt", "ads",
    "SELECT ad_id, "
    + _by_task(
        lambda t: f"{C.quoted(K.ZERO_SHOT_PREFIX[t])} || 'Job Advertisement:' || chr(10) || "
        f"{C.strip('job_ad_details')} || chr(10)",
    )
    + " FROM ads",
)
def tx11(ads: DataFrame) -> DataFrame:
    ad = F.col("job_ad_details")
    return ads.select("ad_id", *[T.zero_shot_prompt(ad, t).alias(t) for t in K.ZERO_SHOT_PREFIX])


_EXPERT = " ".join(
    f"WHEN {C.quoted(task)} THEN replace({C.quoted(template)}, '{{prompt}}', prompt)"
    for task, template in K.EXPERT_TEMPLATE.items()
)


@register(
    "tx12_expert_prompt", "predictions",
    f"""WITH t AS (SELECT row_id, prompt, {C.task_type("prompt", "default")} AS task FROM predictions)
SELECT row_id, CASE task {_EXPERT} ELSE prompt END AS prompt FROM t""",
)
def tx12(predictions: DataFrame) -> DataFrame:
    prompt = F.col("prompt")
    return predictions.select(
        "row_id", T.expert_prompt(prompt, T.task_type(prompt, "default")).alias("prompt")
    )


def _last_field(name: str) -> str:
    pattern = C.quoted(rf"(?i)^\s*{name}\s*:\s*(.*)$")
    return (
        f"regexp_extract(list_filter(head, lambda t: regexp_matches(t, {pattern}))[-1], {pattern}, 1)"
    )


PARTED = f"""lined AS (SELECT ad_id, prompt,
    string_split(regexp_replace(prompt, '\\n\\z', ''), chr(10)) AS lines FROM header_ads),
placed AS (SELECT *, coalesce(list_position(
    list_transform(lines, lambda t: starts_with(lower(t), 'contents:')), true), 0) AS start FROM lined),
headed AS (SELECT *, CASE WHEN start = 0 THEN lines ELSE lines[1:start - 1] END AS head,
    CASE WHEN start = 0 THEN '' ELSE array_to_string(lines[start:], chr(10)) END AS tail FROM placed),
parted AS (SELECT ad_id, tail, {", ".join(
    f"{C.strip(_last_field(name))} AS {name.lower().replace(' ', '_')}" for name in K.HEADER_FIELDS
)} FROM headed)"""


@register(
    "tx13_split_header", "header_ads",
    f"WITH {PARTED} SELECT ad_id, job_title, abstract, employer, location, highlights, tail FROM parted",
    heavy=True,
)
def tx13(ads: DataFrame) -> DataFrame:
    return ads.select("ad_id", T.split_header(F.col("prompt")).alias("h")).select("ad_id", "h.*")


REBUILT = """concat_ws(chr(10), 'Job Title: ' || job_title, 'Abstract: ' || abstract,
  'Employer: ' || employer, 'Location: ' || location, 'Highlights: ' || highlights)
  || CASE WHEN tail = '' THEN '' ELSE chr(10) || ltrim(tail, chr(10)) END"""


@register("tx14_build_header", "header_ads", f"WITH {PARTED} SELECT ad_id, {REBUILT} AS prompt FROM parted", heavy=True)
def tx14(ads: DataFrame) -> DataFrame:
    return ads.select("ad_id", T.build_header(T.split_header(F.col("prompt"))).alias("prompt"))


@register(
    "tx15_message_preview", "transcripts",
    f"""WITH s AS (SELECT conv_id, idx, name, {C.strip("content")} AS said FROM transcripts)
SELECT conv_id, idx, '[' || cast(idx + 1 AS VARCHAR) || '] ' || name || ': ' || substr(said, 1, 200)
  || CASE WHEN length(said) > 200 THEN '...' ELSE '' END AS line FROM s""",
)
def tx15(messages: DataFrame) -> DataFrame:
    line = T.message_preview(F.col("idx"), F.col("name"), F.col("content"))
    return messages.select("conv_id", "idx", line.alias("line"))
