"""Mixing and line dedup against plain Python."""

import hashlib
import math
import re

import pytest
from fixtures import hard_rows, table
from pyspark.sql import functions as F

from terralane.llm import line_dedup, mixing


def poisson(u, mean):
    k, p = 0, math.exp(-mean)
    c = p
    while c <= u:
        k += 1
        p *= mean / k
        c += p
    return k


def u(*key):
    return (int(hashlib.md5(":".join(map(str, key)).encode()).hexdigest()[:13], 16) + 0.5) / 2**52


def md5(t):
    return hashlib.md5(t.encode()).hexdigest()


def test_copies_follow_the_inverse_distribution(spark):
    rows = [(i, f"t{i}", "en", "a" if i % 4 else "b", 2) for i in range(200)] + [(500, "rare", "en", "c", 4), (501, "none", "en", None, 4)]
    weights = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 1.0)], "source string, weight double")
    docs = table(spark, rows).withColumnRenamed("lang", "copy")
    got = sorted((r.doc_id, r.copy) for r in mixing.mix(docs, weights, total=800).collect())
    want = []
    size = {"a": 150, "b": 50, "c": 1}
    for i, t, _, s, _ in rows:
        if s:
            mean = {"a": 1, "b": 2, "c": 1}[s] / 4 * 800 / size[s]
            parts = math.ceil(mean / mixing.MEAN_STEP)
            n = sum(poisson(u(17, i, md5(t), j), mean / parts) for j in range(1, parts + 1))
            want += [(i, c) for c in range(1, n + 1)]
    assert got == sorted(want)
    assert 150 < sum(i == 500 for i, _ in got) < 250


def test_mix_hard_rows(spark):
    rows = hard_rows()
    out = mixing.mix(table(spark, rows)).collect()
    want = {}
    for i, t in rows:
        s = (i or 0) % 3
        n = sum((j or 0) % 3 == s for j, _ in rows)
        c = poisson(u(17, "null" if i is None else i, md5(t or ""), 1), len(rows) / 3 / n)
        want[i, t] = want.get((i, t), 0) + c
    got = {}
    for r in out:
        got[r.doc_id, r.text] = got.get((r.doc_id, r.text), 0) + 1
    assert got == {k: v for k, v in want.items() if v}
    assert mixing.mix(table(spark, [])).collect() == []


def test_rows_without_ids_draw_for_themselves(spark):
    rows = [(None, f"text {i}", "en", "a", 6) for i in range(4000)]
    assert abs(mixing.mix(table(spark, rows)).count() - 4000) < 200


def test_names_of_helper_columns_are_free(spark):
    rows = [(i, f"own {i}\nboiler", "en", f"s{i % 12}", 0) for i in range(24)]
    docs = table(spark, rows).withColumnsRenamed({"lang": "__source", "n_chars": "__n"}).withColumns({"a.b`c": F.lit(1), "__row": F.lit(3)})
    assert mixing.mix(docs).columns == [*docs.columns, "copy", "position"]
    assert {r["__source"] for r in mixing.mix(docs).collect()} == {"en"}
    out = line_dedup.line_dedup(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_removed"]
    assert {(r["text"].split()[0], r["__row"], r["n_removed"]) for r in out.collect()} == {("own", 3, 1)}


@pytest.mark.parametrize("sent", [line_dedup.SENT_LINES, 0])
@pytest.mark.parametrize("min_sites", [3, 10])
def test_line_ends_of_other_kinds_are_text(spark, monkeypatch, sent, min_sites):
    monkeypatch.setattr(line_dedup, "SENT_LINES", sent)
    ends = ["\x85", "\u2028", "\u2029", "\x1c", "\x0b", "\r"]
    rows = [(i, "\n".join([f"own {i}", *(f"shared line{e2}{e}" for e in ends for e2 in (" ", ""))]), "en", f"s{i}" if i else None, 0) for i in range(12)]
    sites = {}
    strip = lambda x: x.strip(" \t\n\x0b\x0c\r")
    for _, t, _, s, _ in rows:
        for x in t.split("\n"):
            sites.setdefault(strip(x), set()).add(s or "")
    want = sorted((i, "\n".join(x for x in t.split("\n") if len(sites[strip(x)]) < min_sites)) for i, t, *_ in rows)
    assert sorted((r.doc_id, r.text) for r in line_dedup.line_dedup(table(spark, rows), min_sites=min_sites).collect()) == want
    assert all(w == f"own {i}" for i, w in want)


@pytest.mark.parametrize("sent", [line_dedup.SENT_LINES, 0])
def test_line_dedup(spark, monkeypatch, sent):
    monkeypatch.setattr(line_dedup, "SENT_LINES", sent)
    rows = [(i, f"own {i}\n  boiler plate \nend {i % 7}\n", "en", f"s{i % 12}", 0) for i in range(60)]
    rows += [(100, None, "en", "s1", None), (101, "", "en", None, 0), (102, "boiler plate", "en", None, 0), (103, "a\n\n\nboiler plate\n\tb\r", "en", "x", 0)]
    rows += [(104, "\n".join(f"line {k}" for k in range(3000)), "en", "s1", 0), (104, "\n".join(f"line {k}" for k in range(3000)), "en", "s1", 0)]
    got = sorted((r.doc_id, r.text or "", r.n_chars, r.n_lines, r.n_removed) for r in line_dedup.line_dedup(table(spark, rows).withColumnRenamed("lang", "n_removed")).collect())
    sites = {}
    strip = lambda x: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x)
    for _, t, _, s, _ in rows:
        for x in (t or "").split("\n"):
            sites.setdefault(strip(x), set()).add(s or "")
    want = []
    for i, t, _, _, _ in rows:
        lines = t.split("\n") if t is not None else []
        kept = [x for x in lines if not strip(x) or len(sites[strip(x)]) < line_dedup.MIN_SITES]
        want.append((i, "\n".join(kept), None if t is None else len("\n".join(kept)), len(lines), len(lines) - len(kept)))
    assert got == sorted(want)
    assert any(w[4] for w in want)
    assert line_dedup.line_dedup(table(spark, [])).collect() == []


def test_the_deal_numbers_rows_where_they_are_read(spark, monkeypatch):
    rows = [(i % 5, "same text", "en", f"s{i % 3}", 9) for i in range(300)]
    docs = table(spark, rows)
    sent = mixing.mix(docs, total=900)
    monkeypatch.setattr(mixing, "SENT_SOURCES", 0)
    joined = mixing.mix(docs, total=900)
    for out in (sent, joined):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        # the number is a column of the rows below the joins, not made behind a shuffle
        lines = plan.splitlines()
        deal = next(i for i, x in enumerate(lines) if "RepartitionByExpression" in x)
        number = next(i for i, x in enumerate(lines) if "monotonically_increasing_id" in x)
        join = next(i for i, x in enumerate(lines) if "Join" in x)
        assert deal < join < number
    assert sorted(map(str, sent.collect())) == sorted(map(str, joined.collect()))
