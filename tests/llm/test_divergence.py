"""Base counts and distances against plain Python."""

import math
import random
import re
from collections import Counter

from strandfold.llm import divergence as dv

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words, lines, seen, dup = WORD.findall(text), text.split("\n"), set(), 0
    for x in lines:
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    many, hit = {w for w, n in Counter(windows).items() if n > 1}, set()
    for i, w in enumerate(windows):
        if w in many:
            hit |= set(range(i, i + 5))
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(hit)


def rows():
    draw = random.Random(12)
    common = "the a of and to in is it on that was for as with his her they at be this".split()
    rare = [draw.choice("bcdfglmnprst") + draw.choice("aeiou") + draw.choice("bcdlmnrst") + draw.choice("aeiou") + draw.choice("lmnrst") for _ in range(300)]
    clean = [(i, "en", ". ".join(" ".join(draw.choice(common if draw.random() < 0.5 else rare) for _ in range(12)) for _ in range(12)) + f"\nnumber {i}") for i in range(1, 61)]
    shout = (900, "en", "".join(f"X{chr(65 + i % 26)}Q{chr(65 + i // 26)}!! " for i in range(300)))
    odd = [(901, "en", None), (902, None, ""), (903, "xx", "tiny text"), (904, "en", "a b c d e f " * 30), (905, None, "é " * 40 + "\n\nx\n \nx\n"), (None, "en", "no id but ten words are here to be counted well")]
    return [*clean, shout, *odd, clean[0]]


def test_base_counts(spark):
    docs = spark.createDataFrame([(*r, "clash") for r in rows()], "doc_id long, lang string, text string, kept string").repartition(3)
    got, texts = dv.judge(docs).collect(), {}
    assert len(got) == len(rows())
    for d, _, t in rows():
        texts[d] = t
    for r in got:
        want = base(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r["base_failed"] and r["kept"])
    verdict = {r["doc_id"]: r["kept"] for r in got}
    assert not verdict[900] and all(verdict[i] for i in range(1, 61)) and verdict[None]
    assert dv.judge(docs.limit(0)).count() == 0


CLASS_MEMBERS = {
    "lower": "abcdefghijklmnopqrstuvwxyz", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": "0123456789", "space": " \t", "line": "\n\r", "stop": ".,;:?-",
    "quote": "\"'", "symbol": "!#$%&*+/<=>@[\\]^_`{|}~()",
}


def class_of(c):
    point = ord(c)
    if point < 128:
        return next((k for k, v in CLASS_MEMBERS.items() if c in v), "control")
    return "latin" if point < 0x280 else "wide" if point < 0x10000 else "other"


def js(p, q):
    """Jensen-Shannon distance of two dicts of shares."""
    both = {k: (p.get(k, 0.0), q.get(k, 0.0)) for k in {*p, *q}}
    return math.sqrt(sum(x * math.log2(2 * x / (a + b)) / 2 for a, b in both.values() for x in (a, b) if x))


def test_distances_and_verdicts_equal_plain_python(spark):
    given, rules = rows(), dv.Rules()
    sizes, spoken, classes = Counter(), Counter(), {}
    for _, lang, text in given:
        text, lang = text or "", lang or ""
        words, chars = [w.lower() for w in WORD.findall(text)], Counter(map(class_of, text))
        sizes[lang, "chars"] += len(text)
        sizes[lang, "words"] += len(words)
        spoken.update((lang, w) for w in words)
        for k, n in chars.items():
            classes.setdefault(lang, Counter())[k] += n * dv.UNIT // len(text)
    got = {}
    for r in dv.judge(spark.createDataFrame(given, "doc_id long, lang string, text string").repartition(3), rules).collect():
        got.setdefault(r["doc_id"], r)
    judged = 0
    for doc, lang, text in given:
        text, lang, r = text or "", lang or "", got[doc]
        words, far = [w.lower() for w in WORD.findall(text)], False
        if len(text) >= rules.min_class_chars and sizes[lang, "chars"] >= rules.min_language_chars:
            total = sum(classes[lang].values())
            want = js({k: n / len(text) for k, n in Counter(map(class_of, text)).items()}, {k: n / total for k, n in classes[lang].items()})
            assert abs(r["class_distance"] - want) < 1e-9
            far |= want > rules.max_class_distance
            judged += 1
        else:
            assert r["class_distance"] is None
        if len(words) >= rules.min_common_words and sizes[lang, "words"] >= rules.min_language_words:
            common = {w: n / sizes[lang, "words"] for (one, w), n in spoken.items() if one == lang and n >= rules.common_share * sizes[lang, "words"]}
            own = Counter(w if w in common else None for w in words)
            want = js({k: n / len(words) for k, n in own.items()}, {**common, None: max(0.0, 1 - sum(common.values()))})
            assert abs(r["word_distance"] - want) < 1e-9
            far |= want > rules.max_word_distance
            judged += 1
        else:
            assert r["word_distance"] is None
        assert r["kept"] == (not r["base_failed"] and not far)
    assert judged > 100


def test_a_language_may_have_any_name_and_languages_any_number(spark):
    given = [(i, f"l{i % 9}" if i % 10 else "*", t) for i, (_, _, t) in enumerate(rows()[:60])]
    docs = spark.createDataFrame(given, "doc_id long, lang string, text string")
    one = sorted(map(tuple, dv.judge(docs).collect()))
    assert all(r[7] for r in one)
    assert sorted(map(tuple, dv.judge(docs, dv.Rules(block_languages=3)).collect())) == one


def test_a_reference(spark):
    docs = spark.createDataFrame([r[1:] for r in rows()], "lang string, text string").repartition(4)
    rules = dv.Rules(common_share=0.02, min_language_chars=3000)
    known = dv.build_references(dv.reference_counts(dv._named(docs, "lang", "text"), rules).collect(), rules)
    counts = Counter(w.lower() for _, lang, t in rows() if lang == "en" for w in WORD.findall(t or ""))
    common = {w: n for w, n in counts.items() if n >= 0.02 * sum(counts.values())}
    assert sorted(known) == ["en"]
    assert len(known["en"].words) == len(common) and abs(known["en"].shares[:-1].sum() - sum(common.values()) / sum(counts.values())) < 1e-12
