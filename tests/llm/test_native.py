"""The operators of DataFrame functions alone: licences, sharding and line templates."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from voxtally.llm import licences, line_templates, sharding


def python_free(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def twin(rows, sql):
    link = duckdb.connect()
    link.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    if rows:
        link.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    result = link.execute(sql)
    names = [d[0] for d in result.description]
    return sorted((dict(zip(names, r, strict=True)) for r in result.fetchall()), key=repr)


def rows_of(df, names):
    return sorted(({n: r[n] for n in names} for r in df.collect()), key=repr)


def test_licence_scan_ignores_case_punctuation_copyright_and_spelling(documents):
    mit = licences.MIT
    rows = [
        (1, mit),
        (2, "Copyright (c) 2020 Somebody\n\n" + mit.upper().replace(",", " ;")),
        (3, mit.replace("sublicense", "sub-license")),
        (4, mit + " except on Sundays"),
        (5, "some prose\nreleased under the MIT licence\nmore prose\nLicensed under CC BY-NC 4.0"),
        (6, None),
        (7, "Copyright 2020 X"),
        (7, "Copyright 2020 X"),
    ]
    df = licences.scan(documents(rows))
    python_free(df)
    got = {r["doc_id"]: (r["licence"], r["n_licence_lines"], r["line_licences"]) for r in df.collect()}
    assert got[1][0] == got[2][0] == got[3][0] == "MIT"
    assert got[4][0] is None
    assert got[5] == (None, 2, "CC-BY-NC-4.0,MIT")
    assert got[6] == got[7] == (None, 0, "")
    assert rows_of(df, ["doc_id", "digest", "licence", "n_licence_lines", "line_licences"]) == twin_named(rows, licences.scan_sql(), ["doc_id", "digest", "licence", "n_licence_lines", "line_licences"])


def test_known_texts_are_found_whole_and_as_runs_of_lines(documents):
    rows = [(k, text) for k, (_, text) in enumerate(licences.KNOWN)]
    wrapped = [(100 + k, f"Some project\n\nCopyright 2020 X\n{text}\n\nend of file") for k, (_, text) in enumerate(licences.KNOWN)]
    other = [(200, licences.BSD_2), (201, licences.MIT.split("\n")[0]), (202, "\n".join([licences.ZLIB] * 3)), (203, None), (204, "")]
    df = licences.scan(documents(rows + wrapped + other))
    python_free(df)
    got = {r["doc_id"]: r for r in df.collect()}
    for k, (name, _) in enumerate(licences.KNOWN):
        assert got[k]["licence"] == name
        assert got[100 + k]["licence"] is None and name in got[100 + k]["line_licences"].split(",")
    assert got[200]["line_licences"] == got[201]["line_licences"] == ""
    assert (got[202]["n_licence_lines"], got[202]["line_licences"]) == (3, "Zlib")
    names = ["doc_id", "digest", "licence", "n_licence_lines", "line_licences"]
    assert rows_of(df, names) == twin_named(rows + wrapped + other, licences.scan_sql(), names)


@pytest.mark.parametrize("text", ["x" * 2_000_000, " " * 2_000_000, "\n" * 200_000, "a b\n" * 200_000])
def test_licence_scan_of_very_long_texts(documents, text):
    got = licences.scan(documents([(1, text), (2, licences.MIT)])).collect()
    assert {r["doc_id"]: r["licence"] for r in got} == {1: None, 2: "MIT"}


def twin_named(rows, sql, names):
    return sorted(({n: r[n] for n in names} for r in twin(rows, sql)), key=repr)


def test_licence_scan_of_odd_rows(documents, odd_rows):
    names = ["doc_id", "digest", "licence", "n_licence_lines", "line_licences"]
    assert rows_of(licences.scan(documents(odd_rows)), names) == twin_named(odd_rows, licences.scan_sql(), names)
    assert licences.scan(documents(odd_rows).limit(0)).count() == 0


def boilerplate():
    rng = random.Random(2)
    rows = []
    for i in range(120):
        lines = [" ".join(f"t{'abcdefgh'[rng.randrange(8)]}{'xyzuvw'[rng.randrange(6)]}" for _ in range(rng.randrange(1, 12))) for _ in range(rng.randrange(1, 8))]
        if i % 3 == 0:
            lines.insert(rng.randrange(len(lines) + 1), f"  posted on 2020-01-{i} by user{i} at page {i}")
        if i % 4 == 0:
            lines.append(f"Subscribe to our free weekly letter today {rng.choice(['Ann', 'Bob', 'Cleo', 'Dan', 'Eve', 'Fay'])}{'' if i % 8 else 's'}")
        if i % 5 == 0:
            lines.append("All rights reserved")
        rows.append((i, "\n".join(lines)))
    return [*rows, (200, rows[7][1]), (201, rows[7][1]), (202, rows[7][1]), (7, rows[7][1])]


@pytest.mark.parametrize("settings", [{}, {"texts": 3}, {"texts": 12}, {"texts": 6, "leading": 2, "fixed": 0.5}])
def test_line_templates_match_sql(documents, settings):
    rows = boilerplate()
    df = line_templates.report(documents(rows), **settings)
    python_free(df)
    names = ["doc_id", "n_lines", "n_kept", "kept_sha256"]
    assert rows_of(df, names) == twin_named(rows, line_templates.report_sql(**settings), names)


def test_recurring_templates_go_and_prose_stays(documents):
    rows = boilerplate()
    df = documents(rows)
    got = {r["doc_id"]: r["text"] for r in line_templates.drop_templates(df, texts=10).collect()}
    assert line_templates.drop_templates(df).schema.names == df.columns
    assert not any("posted on" in t or "All rights" in t or "weekly letter" in t for t in got.values())
    assert got[200] == got[7]
    assert sum(len(t) for t in got.values()) > 0.5 * sum(len(t) for _, t in rows)


def test_a_text_of_many_forms_counts_once_for_its_template(documents):
    words = [a + b for a in "abcdefgh" for b in "klmno"]
    rows = [
        # the tokens behind the path stand in the first text alone
        (1, "\n".join(f"job alpha ran step {w} ok then done" for w in words)),
        (2, "job alpha ran step zeta fine and gone"),
        (3, "job alpha ran step theta not so far"),
        # the tokens behind the path stand in three texts each, their template in the first alone
        (4, "\n".join(f"disk beta held block good today {w}" for w in words)),
        *((5 + k, f"disk beta held block good {w} {w}") for k, w in enumerate(["red", "blue"])),
        *((7 + k, f"disk beta held block {w} today {w}") for k, w in enumerate(["pink", "grey"])),
    ]
    footers = [(20 + k, "\n".join(f"seen by gamma house for {w}" for w in words[2 * k : 2 * k + 2])) for k in range(3)]
    df = line_templates.drop_templates(documents(rows + footers), texts=3)
    python_free(df)
    got = {r["doc_id"]: r["text"] for r in df.collect()}
    assert got == {i: t for i, t in rows} | {i: "" for i, _ in footers}
    assert {r["doc_id"]: r["text"] for r in line_templates.drop_templates(documents(rows + footers[:2]), texts=3).collect()} == dict(rows + footers[:2])
    names = ["doc_id", "n_lines", "n_kept", "kept_sha256"]
    for some in (rows + footers, rows + footers[:2]):
        assert rows_of(line_templates.report(documents(some), texts=3), names) == twin_named(some, line_templates.report_sql(texts=3), names)


def test_the_same_lines_go_from_a_table_of_any_size(documents):
    footer = [(i, f"text {'abcdefghijkl'[i]} stands here alone\nsent from the old harbour office") for i in range(line_templates.TEXTS)]
    rare = [(50 + i, f"more {'abcdefghijkl'[i]} for this one\nprinted on both sides of the paper") for i in range(line_templates.TEXTS - 1)]
    rng = random.Random(5)
    others = [(100 + i, " ".join("".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(9))) for i in range(3000)]
    for rows in (footer + rare, footer + rare + others):
        got = {r["doc_id"]: r["text"] for r in line_templates.drop_templates(documents(rows)).collect()}
        assert not any("harbour" in t for t in got.values())
        assert sum("both sides" in t for t in got.values()) == len(rare)


def test_hot_paths_lines_and_copies(documents):
    rng = random.Random(8)
    letters = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    rows = [(i, "page made by the night shift\n" * 3 + f"the last word was {letters(4)} or {letters(5)}") for i in range(900)]
    rows += [(2000 + i, rows[0][1]) for i in range(700)] + [(4000 + i, None) for i in range(300)]
    names = ["doc_id", "n_lines", "n_kept", "kept_sha256"]
    assert rows_of(line_templates.report(documents(rows)), names) == twin_named(rows, line_templates.report_sql(), names)


@pytest.mark.parametrize("text", ["x" * 2_000_000, "ab " * 700_000, " " * 2_000_000, "\n" * 300_000, "7" * 1_000_000 + "z" * 1_000_000])
def test_very_long_lines(documents, text):
    began = time.time()
    got = {r["doc_id"]: r["text"] for r in line_templates.drop_templates(documents([(1, text), (2, "short 1")])).collect()}
    assert got == {1: text, 2: "short 1"}
    assert time.time() - began < 120


def test_tokens_with_digits_are_found_from_their_start(spark):
    lines = ["a1 b c2d 3 e", "1", "ab", " x9  9x ", "é1 中2中 3", "a-1-b2 c", ""]
    df = spark.createDataFrame([(v,) for v in lines], "line string").select("line", line_templates.masked(F.col("line")).alias("got"))
    assert all(r["got"] == re.sub(line_templates.WITH_DIGIT_SQL, line_templates.FIELD, r["line"]) for r in df.collect())


def test_line_templates_of_odd_rows(documents, odd_rows):
    names = ["doc_id", "n_lines", "n_kept", "kept_sha256"]
    assert rows_of(line_templates.report(documents(odd_rows)), names) == twin_named(odd_rows, line_templates.report_sql(), names)
    assert line_templates.report(documents(odd_rows).limit(0)).count() == 0
    assert line_templates.drop_templates(documents([(1, None)])).first()["text"] is None


def best_capacity(sizes, shards):
    """The least largest shard of contiguous partitions, by trying every sum."""
    best = {0: [0]}
    total = [0]
    for s in sizes:
        total.append(total[-1] + s)
    n = len(sizes)
    row = [0] + [float("inf")] * n
    for _ in range(shards):
        row = [min(max(row[j], total[i] - total[j]) for j in range(i + 1)) for i in range(n + 1)]
    del best
    return row[n]


@pytest.mark.parametrize("shards", [1, 3, 16])
def test_shards_are_minimax_and_slots_gapless(documents, shards):
    rng = random.Random(shards)
    rows = [(i, None if i % 17 == 0 else "x" * rng.randrange(0, 60) + str(rng.randrange(30))) for i in range(300)] + [(900, "same")] * 90
    df = sharding.shard(documents(rows), shards=shards, cells=64)
    python_free(df)
    got = df.toPandas()
    assert len(got) == len(rows)
    text = dict(rows)
    assert (got["size"] == got.doc_id.map(lambda i: len((text[i] or "").encode()) + 1)).all()
    assert (got.text_crc32 == got.doc_id.map(lambda i: zlib.crc32((text[i] or "").encode()))).all()
    assert (got.law == "bytes").all()
    assert got.grown_shard.isna().all()
    got["group"] = got.doc_id.map(lambda i: 0 if text[i] is None else int(hashlib.md5(text[i].encode()).hexdigest()[:15], 16))
    assert (got.groupby("group").shard.nunique() == 1).all()
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert got.groupby("shard")["size"].sum().max() == best_capacity(got.groupby("group")["size"].sum().sort_index().tolist(), shards)
    assert got.shard.between(0, shards - 1).all()


def test_the_search_looks_closer_until_cuts_are_exact(spark):
    rng = random.Random(9)
    groups = [(rng.randrange(1 << 60), rng.randrange(1, 1000), 1) for _ in range(5000)] + [(1 << 59, 300_000, 9)]
    df = spark.createDataFrame(groups, "place long, size long, rows long")
    shift = sharding.BITS - 4
    sums = [sharding.Range(r["prefix"], shift, r["size"], r["groups"]) for r in sharding._sums(df, shift).collect()]
    capacity, starts = sharding.minimax_cuts(df, 16, sums)
    ordered = [sharding.Range(p, 0, s, 1) for p, s, _ in sorted(groups)]
    assert capacity == sharding.smallest_capacity(ordered, 16, fluid=False)
    filled = [0] * (len(starts) + 1)
    for p, s, _ in groups:
        filled[sum(p >= c for c in starts)] += s
    assert max(filled) == capacity
    assert len(filled) <= 16


def test_empty_table_has_no_shards(documents):
    assert sharding.shard(documents([(1, "x")]).limit(0)).count() == 0
