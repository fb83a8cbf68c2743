import itertools

from adfacts.functions import rules as R


def heading(name, body):
    return f"<div><h3> {name}\n</h3><span>-</span><p class='x'>{body}</p></div>"


COMPENSATIONS = [
    (None, "AUS", (None, None)),
    ("<p>Compensation: 5</p>", "AUS", (None, None)),
    (heading("Compensation", "700"), "AUS", (700, 700)),
    (heading("Compensation", "5,000"), "AUS", (None, None)),
    (heading("Compensation", "5,000 to 7,000"), "PH", (5000, 5000)),
    (heading("Compensation Range", "90,500 to 10,250 or 99"), "AUS", (99, 10250)),
    (heading("Compensation Range", "<b>8</b>00"), "AUS", (800, 800)),
    (heading("Compensation Range", "20 - 10"), "PH", (10, 20)),
    (heading("Compensation Range", "negotiable"), "AUS", (None, None)),
    (heading("Compensation", "1") + heading("Compensation Range", "3 2"), "SG", (2, 3)),
    (heading("Compensation", "1") + heading("Compensation Range", "3 2"), "PH", (1, 1)),
    (heading("Compensation", "700"), None, (700, 700)),
    ("<h3>Compensation</h3> no paragraph follows", "AUS", (None, None)),
    ("<h3>Compensation</h3><p>12", "AUS", (12, 12)),
    (heading("Compensation Range", "12345678901234567890123 to 5,000"), "AUS", (5000, 5000)),
    (heading("Compensation", "12345678901234567890123 or 7"), "PH", (7, 7)),
]


def test_compensation(values):
    rows = [(html, nation) for html, nation, _ in COMPENSATIONS]
    out = values(R.compensation, rows, "h string, n string")
    for (html, nation, ends), got in zip(COMPENSATIONS, out):
        assert tuple(got) == ends, (html, nation)


def test_pay_frequency_order_and_substrings(values):
    rows = [("phone",), ("three",), ("per year or per week",), ("5 p.m. daily",), ("per day",), ("",)]
    assert values(R.pay_frequency, rows, "t string") == [
        "HOURLY", "HOURLY", "WEEKLY", "MONTHLY", "DAILY", None,
    ]


def test_salary_range(values):
    rows = [
        ("10% bonus on $32.5 - $45.5",), ("13.5 and 9.4",), ("9.5",), ("1,234,567.5",),
        ("none",), (None,), ("12345678901",),
    ]
    out = [tuple(r) for r in values(R.salary_range, rows, "t string")]
    assert out == [
        (32, 46), (14, 14), (10, 10), (1234568, 1234568), (None, None), (None, None),
        (8901, 1234567),
    ]


def by_hand(nation, ranged, low, freq1, freq2):
    if nation == "AUS":
        return (freq1 or "ANNUAL") if ranged and freq2 is None else "ANNUAL"
    if nation == "ID":
        return "MONTHLY"
    if nation in ("MY", "NZ", "PH") and low and freq2 is None:
        return "MONTHLY"
    return freq2 or freq1


def test_resolve_frequency_all_cases(values):
    cases = list(
        itertools.product(
            ["AUS", "ID", "MY", "NZ", "PH", "SG", None], [None, 5], [None, 6], [None, 7], [None, 8],
            [None, "HOURLY"], [None, "WEEKLY"],
        )
    )
    names = "n string, a long, b long, c long, d long, f string, g string"
    want = [
        by_hand(
            n, (a and b) or (c and d), a is not None or c is not None, f, g
        )
        for n, a, b, c, d, f, g in cases
    ]
    assert values(R.resolve_frequency, cases, names) == want


def test_resolve_range_and_format(values):
    names = "n string, a long, b long, c long, d long"
    rows = [("AUS", 1, 2, 3, 4), ("XX", 1, 2, None, 4), ("SG", None, 2, 3, None), ("PH", 0, 2, None, None)]
    out = [tuple(r) for r in values(R.resolve_range, rows, names)]
    assert out == [(3, 4, "AUD"), (1, 2, "None"), (0, 0, "None"), (0, 2, "PHP")]
    rows = [(3, 4, "AUD", "HOURLY"), (0, 2, "PHP", "HOURLY"), (3, 4, "None", None)]
    assert values(R.format_salary, rows, "a long, b long, c string, f string") == [
        "3-4-AUD-HOURLY", "0-0-None-None", "3-4-None-None",
    ]


def test_arrangement(values):
    rows = [
        ("Remote, some days ON-SITE",), ("work from home",), ("telecommuting",), ("remotely",),
        ("onsite",), ("mixed mode",), ("flexible",), (None,), ("virtual in person",),
    ]
    assert values(R.arrangement, rows, "t string") == [
        "Hybrid", "Remote", "Remote", "Onsite", "Onsite", "Hybrid", "Hybrid", "Onsite", "Hybrid",
    ]
    assert values(lambda c: R.arrangement(c, "OnSite"), [("desk",)], "t string") == ["OnSite"]


def test_salary_facts_table(spark):
    from adfacts.operators.salary import salary_facts
    from adfacts.sources.tables import SALARY_ADS

    rows = [
        ("t", heading("Compensation Range", "50 to 90") + " per hour", "AUS", None, None),
        ("t", "<p>x</p>", "SG", "$10 - $20 per week", None),
        ("t", None, None, None, None),
    ]
    out = [r["y_pred"] for r in salary_facts(spark.createDataFrame(rows, SALARY_ADS)).collect()]
    assert out == ["50-90-AUD-HOURLY", "10-20-SGD-WEEKLY", "0-0-None-None"]
