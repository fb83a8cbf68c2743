"""Rules that read pay and work arrangement from an ad."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from adfacts import constants as K
from adfacts.functions.text import decode_entities, lowered, strip, text_or_empty
from adfacts.functions.values import once

# Possessive, so that long runs of blanks take no stack.
_BLANK = r"[\s\x{a0}]*+(?:&nbsp;[\s\x{a0}]*+)*+"


def paragraph_after(html: Column, heading: str) -> Column:
    """Text of the first paragraph after the text node ``heading``, empty if there is none."""
    pattern = (
        rf"(?s)(?:^|>){_BLANK}{heading}{_BLANK}<.*?<[pP](?:\s[^>]*)?>(.*?)(?:</[pP]\s*>|\z)"
    )
    inner = F.regexp_replace(F.regexp_extract(html, pattern, 1), "<[^>]*>", "")
    text = strip(decode_entities(inner))
    return F.when(F.contains(html, F.lit(heading)), text).otherwise(F.lit(""))


def integers(text: Column) -> Column:
    """All integers in the text, thousands commas dropped; one past 64 bits is left out."""
    found = F.regexp_extract_all(text, F.lit(K.INTEGER), F.lit(0))
    numbers = F.transform(found, lambda n: F.replace(n, F.lit(","), F.lit("")).try_cast("bigint"))
    return F.array_compact(numbers)


def compensation(html: Column, nation: Column) -> Column:
    """Struct (min1, max1) from the compensation paragraphs of an ad."""
    in_ph = F.coalesce(nation == "PH", F.lit(False))

    def ends(text: Column, single: Column, band: Column) -> Column:
        low = F.get(band, F.lit(0))
        high = F.when(F.size(band) > 1, F.get(band, F.lit(1))).otherwise(low)
        first = F.get(single, F.lit(0))
        plain = F.when(F.rlike(text, F.lit(r"^[+-]?\d+$")), text.try_cast("bigint"))

        def end(of_band: Column) -> Column:
            return (
                F.when(in_ph & (F.size(single) > 0), first)
                .when(F.size(band) > 0, of_band)
                .when(~in_ph, plain)
            )

        return F.struct(end(low).alias("min1"), end(high).alias("max1"))

    html = text_or_empty(html)
    texts = F.struct(
        paragraph_after(html, "Compensation").alias("single"),
        F.sort_array(integers(paragraph_after(html, "Compensation Range"))).alias("band"),
    )
    return once(
        texts,
        lambda t: once(integers(t["single"]), lambda n: ends(t["single"], n, t["band"])),
    )


def pay_frequency(text: Column) -> Column:
    """The first frequency with a keyword anywhere in the (lowercased) text, else null."""
    chain = F
    for frequency, keywords in K.FREQUENCY_KEYWORDS.items():
        hit = F.lit(False)
        for keyword in keywords:
            hit = hit | F.contains(text, F.lit(keyword))
        chain = chain.when(hit, F.lit(frequency))
    return chain


def salary_range(text: Column) -> Column:
    """Struct (min2, max2) of the amounts of 10 or more in the text; percentages are skipped."""
    found = F.regexp_extract_all(text_or_empty(text), F.lit(K.AMOUNT), F.lit(1))
    plain = F.filter(found, lambda n: ~n.endswith("%"))
    rounded = F.transform(
        plain,
        lambda n: F.bround(F.replace(n, F.lit(","), F.lit("")).try_cast("double"), 0).try_cast(
            "bigint"
        ),
    )
    return once(
        F.filter(rounded, lambda n: n >= 10),
        lambda n: F.struct(F.array_min(n).alias("min2"), F.array_max(n).alias("max2")),
    )


def resolve_frequency(
    nation: Column, min1: Column, max1: Column, min2: Column, max2: Column,
    freq1: Column, freq2: Column,
) -> Column:
    """One frequency from the ad's (1) and the pay text's (2), by the habits of the nation."""
    has_range = (min1.isNotNull() & max1.isNotNull()) | (min2.isNotNull() & max2.isNotNull())
    has_low = min1.isNotNull() | min2.isNotNull()
    return (
        F.when(
            nation == "AUS",
            F.when(has_range & freq2.isNull(), F.coalesce(freq1, F.lit("ANNUAL"))).otherwise(
                F.lit("ANNUAL")
            ),
        )
        .when(nation == "ID", F.lit("MONTHLY"))
        .when(nation.isin("MY", "NZ", "PH") & has_low & freq2.isNull(), F.lit("MONTHLY"))
        .otherwise(F.coalesce(freq2, freq1))
    )


def currency_of(nation: Column) -> Column:
    chain = F
    for name, currency in K.NATION_CURRENCY.items():
        chain = chain.when(nation == name, F.lit(currency))
    return chain.otherwise(F.lit("None"))


def resolve_range(
    nation: Column, min1: Column, max1: Column, min2: Column, max2: Column
) -> Column:
    """Struct (min, max, currency): the pay text's range, else the ad's, else zeros."""
    second = min2.isNotNull() & max2.isNotNull()
    either = second | (min1.isNotNull() & max1.isNotNull())

    def end(one: Column, two: Column) -> Column:
        return F.when(second, two).when(either, one).otherwise(F.lit(0)).cast("bigint")

    currency = F.when(either, currency_of(nation)).otherwise(F.lit("None"))
    return F.struct(
        end(min1, min2).alias("min"), end(max1, max2).alias("max"), currency.alias("currency")
    )


def format_salary(low: Column, high: Column, currency: Column, frequency: Column) -> Column:
    text = F.concat_ws(
        "-", low.cast("string"), high.cast("string"), currency,
        F.coalesce(frequency, F.lit("None")),
    )
    return F.when((low != 0) & (high != 0), text).otherwise(F.lit(K.NO_SALARY))


def _any_of(phrases: list[str]) -> Column:
    return F.lit(rf"\b(?:{'|'.join(phrases)})\b")


def arrangement(text: Column, onsite_label: str = "Onsite") -> Column:
    def label(t: Column) -> Column:
        remote = F.rlike(t, _any_of(K.REMOTE_PHRASES))
        onsite = F.rlike(t, _any_of(K.ONSITE_PHRASES))
        mixed = F.when(onsite, F.lit("Hybrid")).otherwise(F.lit("Remote"))
        return (
            F.when(F.rlike(t, _any_of(K.HYBRID_PHRASES)), F.lit("Hybrid"))
            .when(remote, mixed)
            .otherwise(F.lit(onsite_label))
        )

    return once(lowered(text), label)
