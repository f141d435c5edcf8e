"""Surrogates: nothing real is left, formats hold, values stay apart."""

import re

import pytest

from quire.llm import pii, queries
from tests.conftest import SF_SMALL

# An independent, plainer statement of what is personal in the fixture.
REAL = {
    "email": r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+",
    "ip": r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w.])",
    "phone": r"\+\d{1,3} \(\d{3}\) \d{3}-\d{4}",
    "card": r"(?<!\d)\d{16}(?!\d)",
    "key": r"\bAKIA[0-9A-Z]{16}\b",
    "hex": r"\b[0-9a-f]{18,40}\b",
}


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return (sum(d[0::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def real(text):
    for kind, pattern in REAL.items():
        for m in re.findall(pattern, text or ""):
            if kind != "card" or luhn(m):
                yield kind, m


def test_query(spark):
    old = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    rows = queries.op2_pii(spark, SF_SMALL).collect()
    assert sorted(r.doc_id for r in rows) == sorted(old)
    seen = {}
    for r in rows:
        found = list(real(old[r.doc_id]))
        assert (r.n_replaced > 0) == bool(found) and (r.text == old[r.doc_id]) == (not found)
        assert not any(m in r.text for _, m in found)
        assert len(r.text.split()) == len(old[r.doc_id].split())
        new = list(real(r.text))
        for (k, a), (k2, b) in zip(found, new):
            if k != "email":
                assert k == k2 and re.sub(r"\d", "0", a)[:1].isdigit() == re.sub(r"\d", "0", b)[:1].isdigit()
            assert seen.setdefault((k, a), b) == b  # one value, one surrogate
    for kind in REAL:
        drawn = [b for (k, _), b in seen.items() if k == kind]
        assert len(drawn) == len(set(drawn))
    again = {r.doc_id: r.text for r in queries.op2_pii(spark, SF_SMALL).collect()}
    assert again == {r.doc_id: r.text for r in rows}


def run(spark, texts, **options):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id int, text string, edits string, h int")
    out = pii.pseudonymise(df, **{"key": "test"} | options)
    assert out.columns == df.columns
    return [r.text for r in out.orderBy("doc_id").collect()]


def test_formats_names_and_coreference(spark):
    a, b, c, d, e, f, g, h = run(
        spark,
        [
            "card 4041894974608795, 4041-8949-7460-8795 not 4041894974608796",
            "+1 (988) 555-2485 or +19885552485 or 212-555-1234",
            "Mr. John Smith met Mrs Smith. Later Smith and John left; Smithson stayed. MS SMITH",
            "г-жа Анна Петрова и г-н Пётр Петров. 王小明先生",
            "IBAN GB82 WEST 1234 5698 7654 32, DE89370400440532013000, not DE89370400440532013001",
            "mail Bob@X.org, bob@x.org ip 10.1.2.3 ssn 123-45-6789 v1.2.3.4.5",
            None,
            "plain words, 12 of them, Mr nobody",
        ],
    )
    m = re.fullmatch(r"card (\d{16}), (\d{4}-\d{4}-\d{4}-\d{4}) not 4041894974608796", a)
    assert m and m[1] == m[2].replace("-", "") and m[1][0] == "4" and luhn(m[1]) and m[1] != "4041894974608795"
    m = re.fullmatch(r"\+1 \((\d{3})\) (\d{3})-(\d{4}) or \+1(\d{10}) or \d{3}-\d{3}-\d{4}", b)
    assert m and m[1] + m[2] + m[3] == m[4] != "9885552485"
    m = re.fullmatch(r"Mr\. (\w+) (\w+) met Mrs (\w+)\. Later (\w+) and (\w+) left; Smithson stayed\. MS SMITH", c)
    assert m and m[2] == m[3] == m[4] and m[1] == m[5] and m[1].endswith("ron") and m[2] != "Smith"
    m = re.fullmatch(r"г-жа ([а-яА-Я]+на) ([а-яА-Я]+рова) и г-н ([а-яА-Я]+ил) ([а-яА-Я]+ров)\. ([一-鿿]{3})先生", d)
    assert m and m[5] != "王小明"
    m = re.fullmatch(r"IBAN (GB\d\d [A-Z]{4} \d{4} \d{4} \d{4} \d\d), (DE\d{20}), not DE89370400440532013001", e)
    for x in m.groups():
        x = x.replace(" ", "")
        assert int("".join(str(int(ch, 36)) for ch in x[4:] + x[:4])) % 97 == 1
    m = re.fullmatch(r"mail (\S+@\S+), (\S+@\S+) ip (\d+)\.\d+\.\d+\.\d+ ssn 9\d\d-\d\d-\d{4} v1\.2\.3\.4\.5", f)
    assert m and m[1] == m[2] and int(m[3]) >= 240
    assert g is None and h == "plain words, 12 of them, Mr nobody"


def test_the_key_decides(spark):
    texts = ["call +1 (988) 555-2485"]
    assert run(spark, texts, key="one") == run(spark, texts, key="one") != run(spark, texts, key="two")


def test_collisions_are_redrawn(spark):
    """All two-digit passwords with one prefix leave no room: draws collide,
    are redrawn and grow until all differ from each other and from real ones."""
    values = [f"--------{i:02d}" for i in range(100)]
    out = run(spark, [f"password={v}" for v in values])
    drawn = [t.removeprefix("password=") for t in out]
    assert len(set(drawn)) == 100 and not set(drawn) & set(values)
    assert all(re.fullmatch(r"-{8}\d{2,}", v) for v in drawn)


def test_odd_rows(spark):
    texts = ["", None, "x " * 100000 + "a@b.co" + " y" * 100000, "a@b.co", "a@b.co", "1 2 3 " * 20000, "\\Q$1 a@b.co \\E$2", "Mr. D'Arcy-Łoś $1 D'Arcy-Łoś"]
    got = run(spark, texts)
    assert got[0] == "" and got[1] is None and got[3] == got[4] and got[5] == texts[5]
    assert got[2] == texts[2].replace("a@b.co", got[3]) and got[6] == texts[6].replace("a@b.co", got[3])
    assert "Arcy" not in got[7] and " $1 " in got[7]
    empty = spark.createDataFrame([], "doc_id int, text string")
    assert pii.pseudonymise(empty, "k", count="n").collect() == []
    with pytest.raises(ValueError):
        pii.pseudonymise(empty, "")


def test_no_python_in_the_plan(spark):
    df = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    plan = pii.pseudonymise(df, "k")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan.replace("ArrowEval", "Arrow")


def test_later_mentions_of_short_and_han_names(spark):
    rows = [
        (1, "Mr Li met Dr Wu. Li said to Wu: Lima, Wuhan. (Li)"),
        (2, "王小明先生来了。后来王小明走了，王小明说好。"),
        (3, "王小女士，王小明先生：王小明，王小。"),
        (4, "Li and Wu of no title; 王小明"),
    ]
    got = {r.id: r.text for r in pii.pseudonymise(spark.createDataFrame(rows, "id int, text string"), "k").collect()}
    li, wu = re.fullmatch(r"Mr (\w+) met Dr (\w+)\. .*", got[1]).groups()
    assert got[1] == f"Mr {li} met Dr {wu}. {li} said to {wu}: Lima, Wuhan. ({li})" and li != "Li" and wu != "Wu"
    whole = re.match(r"(\w+)先生来了", got[2])[1]
    assert got[2] == f"{whole}先生来了。后来{whole}走了，{whole}说好。" and whole != "王小明"
    a, b = re.match(r"(\w+)女士，(\w+)先生：", got[3]).groups()
    assert got[3] == f"{a}女士，{b}先生：{b}，{a}。" and a != "王小" and b == whole
    assert got[4] == rows[3][1]


def test_ordinary_words_stay(spark):
    same = [
        "Sr Developer wanted; Miss Universe; Dr Engineer", "secret: ingredients of the soup", "build 1.2.3.4, Version 10.0.0.1",
        "我们今天来了，天气好", "In May we left. May I?",
    ]
    a, b, c, d, e, f, *rest = run(
        spark,
        ["我们感谢李先生，李先生来了", "今天王先生和欧阳小姐", "王先生来了，王国", "Ms May met us. In May we left. May I? Ms May", "Mr van Gogh met Mr. de Vries; van Gogh left", "secret: 8f2a-77b1c"] + same,
    )
    m = re.fullmatch(r"我们感谢(.)先生，(.)先生来了", a)
    assert m and m[1] == m[2] != "李"
    m = re.fullmatch(r"今天(.)先生和(.{2})小姐", b)
    assert m and m[1] != "王" and m[2] != "欧阳"
    assert re.fullmatch(r"[^王]先生来了，王国", c)
    m = re.fullmatch(r"Ms (\w+) met us\. In May we left\. May I\? Ms (\w+)", d)
    assert m and m[1] == m[2] != "May"
    m = re.fullmatch(r"Mr (\w+) met Mr\. (\w+); (\w+) left", e)
    assert m and m[1] == m[3] != m[2] and "Gogh" not in e and "Vries" not in e
    assert f.startswith("secret: ") and f != "secret: 8f2a-77b1c" and rest == same
