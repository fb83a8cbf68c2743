import random
import zlib
from collections import Counter

from edges import EDGES
from adfacts.llm import languages as L

SYLLABLES = {"xx": "ka ri to na mu".split(), "yy": "bel dor fin gra hul".split(), "zz": "éa çu ño ál ôt".split()}


def text_of(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 4))) for _ in range(n)).title()


def profile(text):
    """Ranked n-grams by plain counting."""
    words = [" " + w + " " for w in L.LETTERS.findall((text or "").lower())]
    found = Counter()
    for word in words:
        for n in (1, 2, 3):
            for i in range(len(word) - n + 1):
                gram = word[i:i + n]
                if gram.strip(" ") and " " not in gram[1:-1]:
                    found[gram] += 1
    return found


def number(gram):
    out = 0
    for ch in gram:
        out = (out << L.BITS) | ord(ch)
    return out


def best(found):
    return sorted((number(g) for g in found), key=lambda k: k)


def ranks(found):
    named = {number(g): n for g, n in found.items()}
    return sorted(named, key=lambda k: (-named[k], k))[:L.PROFILE]


def planted():
    rng = random.Random(9)
    docs = [(i, text_of(rng, rng.choice(list(SYLLABLES)), rng.randrange(1, 60)), "?", "s", 1) for i in range(100, 300)]
    langs = {i: next(x for x in SYLLABLES if any(s in t.lower() for s in SYLLABLES[x])) for i, t, *_ in docs}
    return [(i, t, langs[i], s, n) for i, t, _, s, n in docs]


def test_matches_plain_counting(spark, folder):
    docs = [*EDGES, *planted()]
    out = L.QUERIES["op8_languages"](spark, folder(documents=docs)).collect()
    assert len(out) == len(docs)
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 3 == 1 for i, *_ in docs}
    sums = {}
    for i, text, lang, *_ in docs:
        if lang and not held[i]:
            sums.setdefault(lang, Counter()).update(profile(text))
    of_lang = {lang: ranks(found) for lang, found in sums.items()}
    for i, text, *_ in docs:
        (row,) = {tuple(r)[1:] for r in out if r["doc_id"] == i and (i is not None)} if i not in (None, 7) else [None]
        if row is None:
            continue
        own = ranks(profile(text))
        if not own:
            assert row == (held[i], "und", 0.0)
            continue
        away = {
            lang: sum(abs(r - theirs.index(g)) if g in theirs else L.PROFILE for r, g in enumerate(own))
            for lang, theirs in of_lang.items()
        }
        first, second = sorted(away.values())[:2]
        want = min(sorted(away), key=away.get)
        assert row == (held[i], want, (second - first) / second if second else 0.0), i


def test_held_out_accuracy(spark, folder):
    docs = planted()
    out = L.QUERIES["op8_languages"](spark, folder(documents=docs)).collect()
    lang = {i: x for i, _, x, *_ in docs}
    tested = [r for r in out if r["held_out"]]
    assert len(tested) > 40
    assert sum(lang[r["doc_id"]] == r["lang_pred"] for r in tested) / len(tested) > 0.97


def test_pieces_of_a_long_text_count_alike(monkeypatch):
    points = L.letters_of(text_of(random.Random(2), "yy", 500))
    kinds, numbers = L.counted(points)
    monkeypatch.setattr(L, "PIECE", 37)
    again, same = L.counted(points)
    assert kinds.tolist() == again.tolist() and numbers.tolist() == same.tolist()


def test_nothing_to_learn_from(spark, folder):
    unlabelled = [(i, t, None, s, n) for i, t, _, s, n in EDGES]
    out = L.QUERIES["op8_languages"](spark, folder(documents=unlabelled)).collect()
    assert len(out) == len(EDGES) and {(r["lang_pred"], r["score"]) for r in out} == {("und", 0.0)}
    assert L.QUERIES["op8_languages"](spark, folder()).collect() == []


def test_numerals_are_no_letters_and_marks_belong_to_words(spark, folder):
    docs = planted() + [(1, "½ ² ③ Ⅳ ٣ 12 _", "xx", "s", 1), (2, "a½b", "xx", "s", 1)]
    out = {r["doc_id"]: r for r in L.QUERIES["op8_languages"](spark, folder(documents=docs)).collect()}
    assert (out[1]["lang_pred"], out[1]["score"]) == ("und", 0.0) and out[2]["lang_pred"] != "und"
    assert L.LETTERS.findall("हिन्दी में a½b e\u0301 \u0301") == ["हिन्दी", "में", "a", "b", "e\u0301"]
