"""Operator 3 against Python's regex engine and hand cases."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from tagweave.llm import pii
from tagweave.llm import queries as Q

PLAIN = [re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
         re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base(text):
    def ok(kind, m):
        d = re.sub("[^0-9]", "", m)
        return [True, all(int(p) <= 255 for p in m.split(".")) if kind == 1 else True, 12 <= len(d) <= 19 and luhn(d), 9 <= len(d) <= 15][kind]
    return sorted((m.start(), k, m.end()) for k, p in enumerate(PLAIN) for m in p.finditer(text) if ok(k, m.group()))


def documents():
    rng = random.Random(3)
    parts = ["a", "b1", "@", ".", "-", " ", "1", "22", "4", "255", "256", "+", "(", ")", "é", "😀", "x@y.co", "1.2.3.4", "4539578763621486",
             "+1 (017) 555-7713", "  ", "%", "_", "\n"]
    docs = {i: "".join(rng.choice(parts) for _ in range(rng.randint(0, 50))) for i in range(800)}
    docs |= {1000: None, 1001: "", 1002: "1 2 " * 2000, 1003: "9" * 5000, 1004: "a" * 3000, 1005: "x@y.co " * 500, 1006: docs[5]}
    docs |= {2000 + i: f"You can phone me on +1 (017) 555-{7000 + i} tomorrow" for i in range(12)}
    docs |= {3000: "You can phone me on 555-1234567 tomorrow", 3001: "the number 555-1234567 here"}
    return docs


def test_base_spans_and_discoveries(spark, table_dir):
    docs = documents()
    d = table_dir(spark, "documents", list(docs.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in Q.op3_pii(spark, d).collect()}
    assert len(got) == len(docs)
    for i, t in docs.items():
        spans = base(t or "")
        text = ",".join(f"{pii.KINDS[k]}:{a}:{e}" for a, k, e in spans)
        r = got[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[1] == k for x in spans) for k in range(4)], i
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(text.split(",")) <= set(r.spans.split(",")) or not text
    # taught by the twelve seeds, and only there
    assert got[3000].spans == "phone:20:31"


def test_as_many_unseen_as_seeds(spark):
    docs = {i: f"You can phone me on +1 (017) 555-{7000 + i} tomorrow" for i in range(12)}
    docs |= {100 + i: f"You can phone me on 555-{1234567 + i} tomorrow" for i in range(40)}
    # as many contradicting instances as seeds: numbers of another shape, and seeds of another kind
    docs |= {200 + i: f"the value was +1 (018) 555-{7000 + i} today" for i in range(12)}
    docs |= {300 + i: f"the value was {10 ** 16 + i} today" for i in range(12)}
    docs |= {400 + i: f"the value was 555-{2234567 + i} today" for i in range(3)}
    docs |= {500 + i: f"please contact +1 (019) 555-{7000 + i} anytime" for i in range(6)}
    docs |= {600 + i: f"please contact u{i}@mail.org anytime" for i in range(6)}
    docs |= {700 + i: f"please contact 555-{3234567 + i} anytime" for i in range(3)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    found = pii.find_identifiers(df).select("doc_id", pii.span_list(F.col("pii")).alias("s")).collect()
    got = {r.doc_id: r.s for r in found}
    assert all(got[100 + i] == "phone:20:31" for i in range(40))
    # no pattern of two kinds counts alike for both
    assert all(got[400 + i] == "" for i in range(3))
    assert all(got[i].startswith("phone:") for i in [*range(12), *range(200, 212), *range(500, 506)])


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "mail a@b.co")], "doc_id long, text string")
    plan = pii.find_identifiers(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_mask_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "é mail a@b.co now, +1 (017) 555-7713 x", "p", "k"), (2, None, None, None)],
                               "doc_id long, text string, pii string, start string")
    out = pii.find_identifiers(df)
    r = {x.doc_id: x for x in out.withColumn("m", pii.mask(F.col("text"), F.col("pii"))).collect()}
    assert r[1].m == "é mail [email] now, [phone] x" and r[1].start == "k" and r[2].m is None and r[2].pii == []


def test_empty_table(spark):
    assert pii.find_identifiers(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_clashing_columns_and_salted_joins(spark):
    names = ["id", "text", "__base", "__cand", "__key", "__p_ip", "__plain", "__added", "pii", "c0", "c1", "salt__"]
    texts = [f"You can phone me on +1 (017) 555-{7000 + i} tomorrow" for i in range(12)] + ["You can phone me on 555-1234567 tomorrow"] * 20
    rows = [(i, t, *[f"{n}{i}" for n in names[2:]]) for i, t in enumerate(texts + [None, ""])]
    df = spark.createDataFrame(rows, names)
    for max_bytes in (pii.MAX_BROADCAST_BYTES, 0):
        out = pii.find_identifiers(df, max_bytes=max_bytes)
        assert out.columns == [n for n in names if n != "pii"] + ["pii_base", "pii"]
        got = {r.id: r for r in out.select("*", pii.span_list(F.col("pii")).alias("s")).collect()}
        assert len(got) == len(rows)
        assert all(got[i].s == "phone:20:31" and got[i]["__key"] == f"__key{i}" and got[i]["__base"] == f"__base{i}" for i in range(12, 32))
        assert got[32].s == got[33].s == ""
