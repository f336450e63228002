"""Personal data: base spans against Python's regular expressions, disclosing terms against counts made one by one."""

import math
import random
import re
from collections import defaultdict

from labelflow.llm import disclosure as D

from .conftest import EXTRA, SCHEMA, sentence

BASE = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def fits(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15 if kind == "phone" else True


def base_spans(text):
    """(start, order, kind, stop) of one text."""
    found = [
        (m.start(), order, kind, m.end())
        for order, (kind, pattern) in enumerate(BASE)
        for m in pattern.finditer(text or "")
        if fits(kind, m.group())
    ]
    return sorted(found)


WORD = re.compile(
    r"""(?<![^ \t\n\x0b\f\r("'\[{<])[^\W_](?:(?:[^\W_]|[_'’-])*[^\W_])?(?=[.,;:!?)"'\]}>]*(?:[ \t\n\x0b\f\r]|\Z))"""
)


def words(text):
    return [w for w in (m.group().lower() for m in WORD.finditer(text)) if len(w) >= D.TERM and re.search(r"[^\W\d_]", w)]


def classes(some):
    return set(some) | {w[: (len(w) + 1) // 2] + "*" for w in some}


def disclosing(texts):
    """term -> replacement, by counting every pair."""
    n, held, entity, both, contexts = len(texts), defaultdict(int), defaultdict(int), defaultdict(int), defaultdict(set)
    for text in texts:
        for key in classes(words(text)):
            held[key] += 1
        near = defaultdict(set)
        for kind, pattern in BASE:
            matches = [(m.start(), m.end()) for m in pattern.finditer(text)]
            for i, (a, b) in enumerate(matches):
                value = text[a:b]
                if not fits(kind, value):
                    continue
                left = text[matches[i - 1][1] if i else 0 : a]
                if len(left) > D.WINDOW:
                    left = re.sub(r"^\S+", "", left[-D.WINDOW :])
                right = text[b : matches[i + 1][0] if i + 1 < len(matches) else len(text)]
                if len(right) > D.WINDOW:
                    right = re.sub(r"\S+$", "", right[: D.WINDOW + 1])
                own = frozenset(classes(words(left) + words(right)))
                name = kind, value.lower() if kind == "email" else value if kind == "ip" else re.sub("[^0-9]", "", value)
                near[name].add(own)
        for name, some in near.items():
            entity[name] += 1
            for key in set().union(*some):
                both[name, key] += 1
                contexts[name, key] |= {c for c in some if key in c}
    told = set()
    for (name, key), joint in both.items():
        content = math.log2(n / entity[name])
        mutual = math.log2(joint * n / (entity[name] * held[key]))
        if content >= D.LEAST_BITS and mutual >= D.ALPHA * content - 1e-12 and len(contexts[name, key]) >= D.SUPPORT:
            told.add(key)
    return {t: D.REMOVED if t[: (len(t) + 1) // 2] + "*" in told else t[: (len(t) + 1) // 2] + "*" for t in told if not t.endswith("*")}


def checked(spark, df, rows):
    texts = [t or "" for _, t in rows]
    told = disclosing(texts)
    expected = []
    for (i, _), text in zip(rows, texts, strict=True):
        added = [(m.start(), 4, "term", m.end()) for m in WORD.finditer(text) if m.group().lower() in told]
        expected.append((i, sorted(base_spans(text) + added)))
    got = [(r.doc_id, [(s.start, s.order, s.kind, s.stop) for s in r.spans]) for r in D.find_personal(df).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    return told


def made(spark, rows, parts=4):
    return spark.createDataFrame([(i, t, *EXTRA) for i, t in rows], SCHEMA).repartition(parts)


def test_base_spans_of_odd_texts(spark, with_null_ids):
    df, rows = with_null_ids
    more = [
        (300, "a.b@c.d_e@f.gh x@y z@z.z, +1 (243) 555-5526. +12 +123456789 +1-2-3-4-5-6-7-8-9-0-1-2-3-4-5-6"),
        (301, "1.2.3.4.5.6.7.8 999.1.1.1 0255.000.1.2 12.34.56 1.2.3.4@5.6 4111 1111 1111 1111 4111-1111-1111-1112"),
        (302, "5" * 30_000 + " " + "4 " * 20_000 + "+1" + "(" * 3_000 + "2" + "a" * 6_000 + "@" + "b." * 3_000),
        (303, "é 4111111111111111 漢字 mail@例.com me@ex-ample.co.uk"),
        (304, "a@b.c\n" * 3_000),
    ]
    checked(spark, df.unionByName(made(spark, more)), rows + more)


def test_terms_that_disclose(spark):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        text = sentence(rng, 40, 60)
        if i % 10 == 0:
            text += f" The Zebrafish-Keeper, {sentence(rng, 2, 60)}: keeper@zoo.example.org ok {sentence(rng, 3, 60)}"
        if i % 25 == 1:
            text += " zebra zebrawood without address"
        if i % 30 == 7:
            text += f" call quokka{i % 60} on +1 (243) 555-5526 {sentence(rng, 3, 60)}"
        rows.append((i, text))
    rows += [(1000 + i, f"unique copy pelican at pel@x.org {rows[2][1]}") for i in range(30)]  # one context
    rows += [(None, rows[10][1]), (None, rows[10][1]), (20, rows[20][1])]
    told = checked(spark, made(spark, rows), rows)
    assert told["zebrafish-keeper"] and "pelican" not in told and told["quokka7"] == D.REMOVED == told["quokka37"]
    df = made(spark, rows)
    out, (spans, clean) = D.sanitize(df)
    got = {r.doc_id: r[clean] for r in out.collect()}
    assert out.columns[: len(df.columns)] == df.columns and out.count() == len(rows)
    assert "[email]" in got[10] and "zoo.example" not in got[10] and "Zebrafish" not in got[10] and "[removed]" in got[7]
    assert got[3] == rows[3][1]


def test_replacing_in_long_texts(spark):
    text = "".join(f"{i:05d}é" for i in range(3000))
    spans = [(5, 9), (7, 20), (8, 12), (1020, 1030), (2048, 3072), (5000, 12000), (17_999, 18_000)]
    kind = f"text string, spans array<{D.SPAN}>"
    rows = [(text, [(a, 0, "x", b, "<>") for a, b in spans]), ("ab", []), ("", [])]
    got = [r[0] for r in spark.createDataFrame(rows, kind).select(D.replaced(D.F.col("text"), D.F.col("spans"))).collect()]
    expected, done = "", 0
    for a, b in spans:
        expected += text[done:a] + ("<>" if b > done else "")
        done = max(done, b)
    assert got == [expected + text[done:], "ab", ""]


def test_empty_table(spark, none):
    assert D.find_personal(none).count() == 0
    assert D.sanitize(none)[0].count() == 0


def test_many_findings_in_one_text(spark):
    text = " ".join(f"u{i}@x{i % 7}.org" for i in range(50_000))
    row = D.find_personal(made(spark, [(1, text)], 1)).first()
    assert len(row.spans) == 50_000 and row.spans[-1].stop == len(text)


def test_many_secrets_in_one_text(spark):
    from labelflow.llm import secret_ledger

    text = " ".join(f"{i:016x}" for i in range(100_000))
    row = secret_ledger.find_secrets(made(spark, [(1, text)], 1)).first()
    assert len(row.spans) == 100_000 and row.spans[-1].stop == len(text) and row.spans[1].start == 17


def test_ledger_written_twice_gives_one_row_each(spark, tmp_path):
    from labelflow.llm import secret_ledger

    df, at = made(spark, [(1, "AKIA" + "Z" * 16), (2, "nothing")]), f"{tmp_path}/ledger"
    first = secret_ledger.find_secrets(df, ledger_path=at).collect()
    spark.read.parquet(at).write.mode("append").parquet(at + "-copy")
    spark.read.parquet(at + "-copy").write.mode("append").parquet(at)
    again = secret_ledger.find_secrets(df, ledger_path=at).collect()
    assert sorted(first) == sorted(again) and len(again) == 2
