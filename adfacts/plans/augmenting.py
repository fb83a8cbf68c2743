"""Queries over augmentation and class top-up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adfacts import constants as K
from adfacts.functions import text as T
from adfacts.operators import augment as A
from adfacts.operators import pairs as P
from adfacts.plans import checksql as C
from adfacts.plans.cleaning import PARTED, REBUILT
from adfacts.plans.registry import register

EMPLOYERS = ["North Mill", "Harbour Clinic", "Bright Freight", "Oak Street School", "Delta Foods"]
TOWNS = ["Ashford", "Millbrook", "Eastport"]
SYNONYMS = {
    "widget": "gadget", "ring": "band", "economy": "budget", "promo": "offer",
    "small": "little", "red": "scarlet", "noise": "sound",
}


@register(
    "au1_header_variants", "header_ads",
    f"""WITH {PARTED}, variants(n, variant) AS (VALUES (0, 'de'), (1, 'fr')),
renamed AS (SELECT ad_id, variant, job_title, abstract, highlights, tail,
    ({C.listed(EMPLOYERS)})[(ad_id * 2 + n) % {len(EMPLOYERS)} + 1] AS employer,
    CASE WHEN location <> '' AND location <> '-' THEN ({C.listed(TOWNS)})[(ad_id * 2 + n) % {len(TOWNS)} + 1]
      ELSE location END AS location
  FROM parted CROSS JOIN variants)
SELECT ad_id, prompt, complete, 'original' AS variant FROM header_ads
UNION ALL SELECT r.ad_id, {REBUILT}, h.complete, variant FROM renamed r JOIN header_ads h ON h.ad_id = r.ad_id""",
    heavy=True,
)
def au1(ads: DataFrame) -> DataFrame:
    return A.header_variants(ads, EMPLOYERS, TOWNS)


@register(
    "au2_top_up", "label_rows",
    """WITH counts AS (SELECT complete, count(*) AS c FROM label_rows GROUP BY 1 HAVING count(*) < 5),
numbered AS (SELECT *, row_number() OVER (PARTITION BY complete ORDER BY row_id) AS t FROM label_rows),
copies AS (SELECT n.row_id, n.prompt, n.complete, k AS copy
  FROM (SELECT complete, c, unnest(generate_series(1, 5 - c)) AS k FROM counts) x
  JOIN numbered n ON n.complete = x.complete AND n.t = (k - 1) % c + 1)
SELECT row_id, prompt, complete, 0 AS copy FROM label_rows
UNION ALL SELECT row_id, prompt, complete, copy::INTEGER FROM copies""",
)
def au2(rows: DataFrame) -> DataFrame:
    return A.top_up(rows)


_WORDS = "regexp_extract_all(prompt, '[\\p{L}]+|[^\\p{L}]+')"
_KNOWN = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in SYNONYMS.items()) + "}"


@register(
    "au3_one_synonym", "header_ads",
    f"""WITH w AS (SELECT ad_id, {_WORDS} AS words FROM header_ads),
p AS (SELECT *, list_position(list_transform(words, lambda x: list_contains({C.listed(list(SYNONYMS))}, lower(x))), true) AS hit FROM w)
SELECT ad_id, CASE WHEN hit > 0 THEN array_to_string(words[1:hit - 1], '') || ({_KNOWN})[lower(words[hit])]
  || array_to_string(words[hit + 1:], '') ELSE array_to_string(words, '') END AS prompt FROM p""",
    heavy=True,
)
def au3(ads: DataFrame) -> DataFrame:
    return ads.select("ad_id", A.one_synonym(F.col("prompt"), SYNONYMS).alias("prompt"))


@register(
    "au3_synonym_table", "header_ads synonyms",
    f"""WITH pieces AS (SELECT ad_id, words, unnest(words) AS piece, generate_subscripts(words, 1) AS place
  FROM (SELECT ad_id, {_WORDS} AS words FROM header_ads)),
hits AS (SELECT ad_id, arg_min(synonym, place) AS synonym, min(place) AS hit
  FROM pieces JOIN synonyms ON word = lower(piece) GROUP BY 1)
SELECT h.ad_id, CASE WHEN hit IS NULL THEN prompt ELSE array_to_string(words[1:hit - 1], '') || synonym
  || array_to_string(words[hit + 1:], '') END AS prompt
FROM (SELECT *, {_WORDS} AS words FROM header_ads) h LEFT JOIN hits USING (ad_id)""",
    heavy=True,
)
def au3_table(ads: DataFrame, synonyms: DataFrame) -> DataFrame:
    return A.first_synonyms(ads.select("ad_id", "prompt"), synonyms, "ad_id")


_CHANGED = """CASE WHEN hit > 0 THEN array_to_string(words[1:hit - 1], '') || ({known})[lower(words[hit])]
  || array_to_string(words[hit + 1:], '') ELSE array_to_string(words, '') END"""


@register(
    "au2_top_up_synonym", "rare_rows",
    f"""WITH counts AS (SELECT complete, count(*) AS c FROM rare_rows GROUP BY 1 HAVING count(*) < 5),
numbered AS (SELECT *, row_number() OVER (PARTITION BY complete ORDER BY row_id) AS t,
  list_position(list_transform(words, lambda x: list_contains({C.listed(list(SYNONYMS))}, lower(x))), true) AS hit
  FROM (SELECT *, {_WORDS} AS words FROM rare_rows)),
copies AS (SELECT n.*, k AS copy
  FROM (SELECT complete, c, unnest(generate_series(1, 5 - c)) AS k FROM counts) x
  JOIN numbered n ON n.complete = x.complete AND n.t = (k - 1) % c + 1)
SELECT row_id, prompt, complete, 0 AS copy FROM rare_rows
UNION ALL SELECT row_id, {_CHANGED.format(known=_KNOWN)}, complete, copy::INTEGER FROM copies""",
)
def au2_synonym(rows: DataFrame) -> DataFrame:
    return A.top_up(rows, change=lambda text: A.one_synonym(text, SYNONYMS))


def _tagged(task: str, column: str) -> str:
    return (
        f"{C.quoted(K.TAGGED_PREFIX[task])} || 'job ad: ' || chr(10) || coalesce({column}, '') "
        "|| chr(10) || chr(10)"
    )


_STACK = [("salary", "salary_additional_text"), ("seniority", "job_title"), ("arrangement", "job_ad_details")]


@register(
    "au4_stacked_tasks", "ads",
    " UNION ALL ".join(
        f"SELECT ad_id, {_tagged(task, column)} AS prompt, {i} AS task_order, '{task}' AS task FROM ads"
        for i, (task, column) in enumerate(_STACK)
    ),
)
def au4(ads: DataFrame) -> DataFrame:
    return P.stacked(
        {
            task: ads.select("ad_id", T.tagged_prompt(F.col(column), task).alias("prompt"))
            for task, column in _STACK
        }
    )


@register(
    "au5_label_counts", "label_rows",
    "SELECT complete, count(*) AS rows FROM label_rows GROUP BY 1",
)
def au5(rows: DataFrame) -> DataFrame:
    return A.label_counts(rows)


@register(
    "au5_label_drift", "train_labels test_labels",
    """SELECT complete AS label, 'train' AS only_in FROM (SELECT complete FROM train_labels EXCEPT SELECT complete FROM test_labels)
UNION ALL SELECT complete, 'test' FROM (SELECT complete FROM test_labels EXCEPT SELECT complete FROM train_labels)""",
)
def au5_drift(train: DataFrame, test: DataFrame) -> DataFrame:
    return A.label_drift(train, test)
