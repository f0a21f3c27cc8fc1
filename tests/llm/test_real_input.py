"""The corpus operators on input as it comes: notices, repeated and null ids, clashing columns, long texts, large groups, empty tables."""

from __future__ import annotations

import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folioframe.llm import decontamination, exchange, jaccard_join, language_id, license_scan, line_dedup, packing, quality_model, quality_rules, sql, store, substring_dedup, token_counts
from llm.test_operators import SCHEMA, corpus, frame, split

S = license_scan.SENTENCES
APACHE = """Copyright 2020 The Example Authors

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
BSD = """Copyright (c) 2019, Example. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

""" + S["bsd-disclaimer"].replace("AND CONTRIBUTORS", "AND\nCONTRIBUTORS")
GPL = """exampled - a daemon
Copyright (C) 2021 Example

This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>."""
MIT = "Copyright (c) 2022 Example\n\n" + S["mit-grant"].replace(", to deal", ",\nto deal") + "\n\n" + S["mit-notice"] + "\n\n" + S["as-is-software"] + " " + S["mit-liability"]


def twin(docs, query: str) -> list[tuple]:
    con = duckdb.connect()
    con.register("rows", docs.toPandas())
    con.execute("CREATE VIEW documents AS SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(text AS VARCHAR) AS text FROM rows")
    cur = con.execute(query)
    names = [d[0] for d in cur.description]
    return sorted((tuple(dict(zip(names, r, strict=True))[n] for n in sorted(names)) for r in cur.fetchall()), key=str)


@pytest.mark.parametrize("leader", ["", "// ", " * ", "# "])
def test_notices_of_files(spark, leader):
    texts = [APACHE, BSD, GPL, MIT, "x = 1\nSPDX-License-Identifier: LGPL-2.1-or-later\n", "This is not released under the MIT License at all.", GPL + "\n\n" + APACHE]
    want = [["Apache-2.0"], ["LicenseRef-all-rights-reserved", "BSD-3-Clause"], ["GPL-3.0-or-later"], ["MIT"], ["LGPL-2.1-or-later"], [], ["GPL-3.0-or-later", "Apache-2.0"]]
    docs = frame(spark, {i: "\n".join(leader + x for x in t.split("\n")) for i, t in enumerate(texts)})
    rows = {r["doc_id"]: r for r in license_scan.scan(docs).collect()}
    assert [rows[i]["licenses"] for i in range(len(texts))] == want
    assert rows[3]["identifiers"] == ["mit-grant", "mit-notice", "as-is-software", "mit-liability"]
    got = sorted(((i, "|".join(r["identifiers"]), "|".join(r["licenses"])) for i, r in rows.items()), key=str)
    assert got == twin(docs, sql.license_scan_sql())


def test_triggers_lose_no_sentence(spark):
    assert all(any(t in s for t in license_scan.TRIGGERS) for s in license_scan.known())
    docs = frame(spark, {0: "THE M\u0130T L\u0130CENSE\nReleased under the M\u0130T L\u0130CENSE", 1: "al\u212a\nMIT License", 2: None})
    rows = license_scan.scan(docs).collect()
    got = sorted(((r["doc_id"], "|".join(r["identifiers"]), "|".join(r["licenses"])) for r in rows), key=str)
    assert got == twin(docs, sql.license_scan_sql())


def test_line_dedup_counts_documents_by_id(spark):
    line = "all of these documents have this line"
    rows = [(1, f"{line}\nown {'abcdefghijkl'[k]}") for k in range(12)] + [(2, line + "\nown text"), (3, "none"), (None, line), (None, line), (4, None), (4, "")]
    rows += [(i, f"a shared line of many\nnumber {'x' * (i % 7)}") for i in range(20, 34)] + [(25, "a shared line of many\nand another")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = line_dedup.clean(docs)
    assert sorted(((r["doc_id"], r["text"], r["_n_dropped"], r["_n_lines"]) for r in got.collect()), key=str) == twin(docs, sql.line_dedup_sql())
    assert got.where("doc_id = 2").first()["_n_dropped"] == 0 and got.where("doc_id = 25").agg(F.min("_n_dropped")).first()[0] == 1


CLASHES = ["_id", "_mark", "_gone", "_key", "_h", "_t", "_w", "_salt", "_rank", "chunk", "start", "s", "b", "k", "template", "leaf", "line", "token", "class", "root", "bucket", "_n_lines", "a.b"]


def test_clashing_columns_change_nothing(spark):
    docs = corpus(n=24) | {40 + i: f"own {i}\nthe same line of many documents" for i in range(12)}
    plain = frame(spark, docs)
    extra = plain.select("*", *(F.lit(str(k)).alias(c) for k, c in enumerate(CLASHES) if c not in plain.columns))
    items = spark.createDataFrame([(0, docs[1])], "item_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(24)], "doc_id long, quality int")
    path = packing.vocabulary_path()
    steps = {
        "1": lambda d: line_dedup.clean(d).select("doc_id", "text", "_n_lines", "_n_dropped"),
        "2": license_scan.scan,
        "3": lambda d: packing.packed(d).select("doc_id", "start", "length", "offset", "sequence_id"),
        "4": lambda d: token_counts.count_tokens(d, path),
        "5": substring_dedup.dedup,
        "6": lambda d: quality_model.score(d, quality_model.fit(d, labels)),
        "7": language_id.identify,
        "8": lambda d: decontamination.matches(d, items),
        "9": quality_rules.judge,
        "10": jaccard_join.join,
    }
    for name, step in steps.items():
        assert sorted(map(str, step(extra).collect())) == sorted(map(str, step(plain).collect())), name
    for name, stage in corpus_pipeline.STAGES[1:3]:
        b = sorted(map(str, stage(spark, plain, "").select("doc_id", "text").collect()))
        a = stage(spark, extra, "")
        assert a.columns == extra.columns and sorted(map(str, a.select("doc_id", "text").collect())) == b, name
        assert a.where("`a.b` <> '%d'" % CLASHES.index("a.b")).isEmpty()


def test_empty_tables(spark, tmp_path):
    none = frame(spark, {})
    labels = spark.createDataFrame([], "doc_id long, quality int")
    items = spark.createDataFrame([], "item_id long, text string")
    assert quality_model.fit(none, labels) is None and quality_model.score(none, None).isEmpty()
    for out in (license_scan.scan(none), token_counts.count_tokens(none, packing.vocabulary_path()), language_id.identify(none), decontamination.matches(none, items)):
        assert out.isEmpty()
    none.write.parquet(f"{tmp_path}/documents.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).isEmpty()


def test_null_and_repeated_ids(spark):
    text = lambda w, n=60: " ".join(f"{w}{'abcdefghij'[k % 10]}{'klmnop'[k // 10]}" for k in range(n))
    rows = [(None, text("u")), (None, text("u")), (None, text("v")), (7, text("u")), (7, text("u")), (8, text("w")), (8, text("x")), (None, None), (9, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.0, "t", 1) for i, t in rows], SCHEMA).repartition(3)
    key = lambda r: (r["doc_id"] or 0, r["n_words"], r["n_removed"])
    assert sorted(map(key, substring_dedup.dedup(docs).collect())) == sorted([(0, 60, 60), (0, 60, 60), (0, 60, 0), (7, 60, 0), (7, 60, 0), (8, 60, 0), (8, 60, 0), (0, 0, 0), (9, 0, 0)])
    assert license_scan.scan(docs).count() == quality_rules.judge(docs).count() == language_id.identify(docs).count() == len(rows)
    assert token_counts.count_tokens(docs, packing.vocabulary_path()).agg(F.sum("n_words")).first()[0] == 7 * 60
    assert packing.packed(docs).agg(F.sum("length")).first()[0] == sum(r["n_tokens"] for r in packing_lengths(docs))
    labels = spark.createDataFrame([(7, 1), (8, 0), (8, 0), (None, 1)], "doc_id long, quality int")
    assert quality_model.score(docs, quality_model.fit(docs, labels)).count() == len(rows)
    items = spark.createDataFrame([(1, text("u")), (2, text("u")), (3, text("x"))], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.matches(docs, items).collect()} == {(7, 1), (7, 2), (8, 3)}


def packing_lengths(docs) -> list[dict]:
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.vocabulary_path())
    return [{"n_tokens": len(tok.encode(r["text"] or "", add_special_tokens=False).ids) + 1} for r in docs.collect()]


def test_pipeline_checks_rows_without_an_id(spark, tmp_path):
    item = " ".join(f"bench{'abcdefghijklmnopqrstuvwxyz'[k]}" for k in range(20))
    rows = [(None, "leak " + item), (None, "clean text of some words"), (5, "leak " + item), (5, "another clean text"), (6, "third clean text here")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), 0.0, "t", 1) for i, t in rows], SCHEMA)
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = {(r["doc_id"], r["text"]) for r in corpus_pipeline.decontaminated(spark, docs, str(tmp_path)).collect()}
    assert left == {rows[1], rows[3], rows[4]}


def test_scopes_delete_their_own_tables_alone(spark, tmp_path):
    df = spark.range(5)
    outside = store.save(df, "outside")
    with store.Scope(spark) as scope:
        first, second = store.save(df, "first"), store.save(df, "second")
    scope.drop(keep=1)
    assert outside.count() == second.count() == 5
    with pytest.raises(Exception, match="(?i)does not exist|no such file|not_exist"):
        first.count()
    joined = jaccard_join.join(frame(spark, corpus(n=8)))
    corpus_pipeline.near_duplicates(spark, frame(spark, corpus(n=8)), "")
    corpus_pipeline.near_duplicates(spark, frame(spark, corpus(n=8)), "")
    assert joined.count() == len(corpus(n=8))


def _votes(rows: list[dict]) -> list[tuple[int, ...]]:
    """The rules' votes by their definition, from the figures of each document."""
    out = []
    for r in rows:
        n, chars = max(r["n_words"], 1), max(r["word_chars"], 1)
        c, marks, odd = r["n_calls"], r["n_symbols"] + r["n_calls"], r["n_other"] + r["n_upper"]
        vote = lambda bad, good: -1 if bad else int(good)
        out.append((
            vote(r["n_words"] < 30, r["n_words"] >= 60),
            vote(r["word_chars"] < 3 * n or r["word_chars"] > 13 * n, 4 * n <= r["word_chars"] <= 10 * n),
            vote(10 * r["n_symbols"] > n, 100 * r["n_symbols"] <= n),
            vote(100 * r["n_other"] > 18 * chars, 100 * r["n_other"] <= 10 * chars),
            vote(10 * r["n_upper"] > 3 * chars, 100 * r["n_upper"] <= 12 * chars),
            vote(100 * r["n_stops"] < n, 100 * r["n_stops"] >= 4 * n),
            vote(10 * marks > n, 100 * marks <= n),
            vote(100 * odd > 25 * chars, 100 * odd <= 18 * chars),
            vote(10 * c > n, 100 * c <= n),
            vote(10 * r["n_dup_lines"] > 3 * r["n_lines"], r["n_dup_lines"] == 0),
            vote(10 * r["n_repeat_words"] > 3 * n, 100 * r["n_repeat_words"] <= 5 * n),
        ))
    return out


def test_quality_verdict_against_em_by_document(spark):
    docs = corpus(9, 80)
    docs |= {i: "### ".join(split(t)) for i, t in docs.items() if t and i % 6 == 0}
    df = frame(spark, docs)
    figures = [r.asDict() for r in quality_rules.figures(df).collect()]
    v = np.array(_votes(figures))
    share, caught, right = 0.8, np.full(v.shape[1], 0.4), np.full(v.shape[1], 0.95)
    up, down = v > 0, v < 0

    def posterior():
        odds = math.log(share / (1 - share)) + (up * np.log(right / (1 - caught)) + down * np.log((1 - right) / caught)).sum(axis=1)
        return 1 / (1 + np.exp(-odds))

    for _ in range(50):
        p = posterior()[:, None]
        bad, voted = (1 - p).sum(), (up | down)
        share = min(max((p.sum() + 8) / (len(v) + 10), 0.05), 0.99)
        accused, cast = ((1 - p) * down).sum(axis=0), ((1 - p) * voted).sum(axis=0)
        weight = quality_rules.POOLING * bad + 10
        caught = np.clip((accused + weight * (accused.sum() + 4) / (cast.sum() + 10)) / (cast + weight), 0.02, 0.98)
        right = np.clip(((p * up).sum(axis=0) + 1.9) / ((p * voted).sum(axis=0) + 2), 0.6, 0.995)
    want = dict(zip((r["doc_id"] for r in figures), posterior(), strict=True))
    for r in quality_rules.judge(df).collect():
        assert r["quality"] == pytest.approx(want[r["doc_id"]], abs=1e-6)
        assert r["kept"] == (not r["base_failed"] and r["quality"] >= 0.5)


def test_language_of_other_scripts_and_many_languages(spark):
    tongue = {"ru": "абвгдежз ийклм", "uk": "абвгґєжз іїклм", "zh": "的一是在不了有和", "ja": "のにはをたがでて", "el": "αβγδεζηθ"}
    r = random.Random(3)
    docs = {i: " ".join("".join(r.choice(tongue[list(tongue)[i % 5]]) for _ in range(6)) for _ in range(25)) for i in range(250)}
    docs = {i: t.upper() if i % 2 else t for i, t in docs.items()}
    got = {x["doc_id"]: x["lang_pred"] for x in language_id.identify(frame(spark, docs, lambda i: list(tongue)[i % 5])).collect()}
    assert sum(got[i] == list(tongue)[i % 5] for i in got) >= 0.98 * len(got)
    order = {"ab": "ба" * 40, "ba": "ааб" * 40}  # the same letters, told apart by their order alone
    pairs = {i: order["ab" if i % 2 else "ba"] for i in range(60)}
    got = {x["doc_id"]: x["lang_pred"] for x in language_id.identify(frame(spark, pairs, lambda i: "ab" if i % 2 else "ba")).collect()}
    assert all(got[i] == ("ab" if i % 2 else "ba") for i in got)
    many = {i: chr(0x4E00 + i) * 12 for i in range(600)}
    names, _, matrix = language_id.fit(frame(spark, many, lambda i: f"l{i}"))
    assert len(names) == 600 and matrix.shape == (language_id.BUCKETS, 600)
    tied = language_id.identify(frame(spark, dict.fromkeys(range(40), "same words"), lambda i: "xy"[i % 2])).collect()
    assert len({x["lang_pred"] for x in tied}) == 1


def test_token_counts_against_naive_on_the_vocabulary(spark):
    path = packing.vocabulary_path()
    vocab = set(token_counts.entries(path))
    longest = max(map(len, vocab))

    def naive(word: str) -> int | None:
        rest, n = (*word.lower().encode(), token_counts.END_MARK), 0
        while rest and rest != (token_counts.END_MARK,):
            size = next((k for k in range(min(longest, len(rest)), 0, -1) if rest[:k] in vocab), None)
            if size is None:
                return None
            rest, n = rest[size:], n + 1
        return n

    docs = {i: t for i, t in corpus(n=20).items()} | {950: "Unbelievably internationalisation 12,345.67 naïve Straße <|x|> " + "z" * 400}
    rows = {r["doc_id"]: r for r in token_counts.count_tokens(frame(spark, docs), path).collect()}
    for i, t in docs.items():
        counts = [naive(w) for w in split(t.lower() if t and t.isascii() else t)]
        assert rows[i]["n_unknown"] == counts.count(None) and rows[i]["n_tokens"] == sum(1 if c is None else c for c in counts), i


def test_substring_index_goes_on_in_another_session(spark, tmp_path):
    docs = corpus(n=24)
    path = f"file://{tmp_path}/index"
    index = substring_dedup.SubstringIndex(spark, fan_in=2, path=path)
    for k in range(4):
        index.add(frame(spark, {i: t for i, t in docs.items() if i % 4 == k}))
    again = substring_dedup.SubstringIndex.open(spark, path)
    assert again.names == index.names and len(again.runs) <= 2
    assert again.add(frame(spark, docs), keep=False).where("n_words >= 13 and n_removed < n_words").isEmpty()


def test_registered_dedup_compacts(spark, monkeypatch):
    seen = []
    compact = substring_dedup.SubstringIndex.compact
    monkeypatch.setattr(substring_dedup.SubstringIndex, "compact", lambda self: (seen.append(len(self.runs)), compact(self)))
    substring_dedup.dedup(frame(spark, corpus(n=24)))
    assert seen == [2]


def test_exchange_grows_with_the_input(spark):
    docs = frame(spark, corpus(n=4))
    few, many = exchange.counts(docs, 1 << 20), exchange.counts(docs, 1 << 40)
    assert few == (4, 4) and many == (-(-(1 << 40) // exchange.CHUNK_BYTES), -(-(1 << 40) // exchange.BUCKET_BYTES))
    text = docs.select(F.lit(None).cast("long").alias("doc_id"), "text")
    assert exchange.dealt(text, 8).select("chunk").distinct().count() > 4


def test_large_group_of_near_copies(spark, monkeypatch):
    """A chain of copies whose neighbours link and whose ends don't, copies around one text, and loners that share its rare words."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 128)
    r = random.Random(4)
    base = [f"w{j}" for j in range(100)]
    docs = {i: " ".join(w if j != i % 100 else f"x{i}" for j, w in enumerate(base)) for i in range(900)}
    for k in range(40):  # a step changes two more words
        docs[2000 + k] = " ".join(w if j >= 2 * k else f"c{j}" for j, w in enumerate(base))
    docs |= {3000 + k: " ".join([*(f"q{r.random()}" for _ in range(60)), *base[:12]]) for k in range(60)}
    docs |= {4000 + k: docs[0] for k in range(700)}
    sets = {i: frozenset(zip(*(w[k:] for k in range(4)), strict=False)) for i, w in ((i, split(t)) for i, t in docs.items())}
    by_text = {}
    for i in sorted(docs):
        by_text.setdefault(sets[i], i)
    ids = sorted(by_text.values())
    root = {i: i for i in ids}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for n, x in enumerate(ids):
        for y in ids[n + 1 :]:
            if 100 * len(sets[x] & sets[y]) >= 85 * len(sets[x] | sets[y]):
                a, b = sorted((find(x), find(y)))
                root[b] = a
    got = {r["doc_id"]: (r["class_id"], r["component_id"]) for r in jaccard_join.join(frame(spark, docs)).collect()}
    assert got == {i: (by_text[sets[i]], find(by_text[sets[i]])) for i in docs}
    assert len({c for _, c in got.values()}) < 80


def test_linked_copies_meet_no_more(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 64)
    asked = []
    links = jaccard_join.links
    monkeypatch.setattr(jaccard_join, "links", lambda docs, tasks, *rest, **more: (asked.append(tasks.count()), links(docs, tasks, *rest, **more))[1])
    base = [f"w{j}" for j in range(200)]
    docs = {i: " ".join(w if j != i % 200 else f"x{i}" for j, w in enumerate(base)) for i in range(1200)}
    assert {r["component_id"] for r in jaccard_join.join(frame(spark, docs)).collect()} == {0}
    assert asked[0] < 2 * 1200 and asked[1] == 0


def _shingles(t: str) -> list[tuple]:
    w = t.split()
    return [tuple(w[k : k + 5]) for k in range(len(w) - 4)]


def test_decontamination_recall_and_selectivity(spark):
    r = random.Random(12)
    words = [f"v{'abcdefghijklmnop'[k % 16]}{'abcdefghijklmnop'[k // 16]}" for k in range(256)]
    items = {k: " ".join(r.choices(words, k=60)) for k in range(150)}
    docs, near = {}, {"0.80-0.85": set(), "0.85-1": set()}
    for k in range(300):
        w = items[k % 150].split()
        start, size = r.randint(0, 30), r.choice([0, 1, 1, 2, 3])
        w[start : start + size] = r.choices(words, k=size)
        docs[k] = " ".join([*r.choices(words, k=r.randint(0, 40)), *w, *r.choices(words, k=r.randint(0, 40))])
    want = {}
    for d, t in docs.items():
        s, item = _shingles(t), _shingles(items[d % 150])
        for a in range(len(s) - len(item) + 1):
            both = sum((Counter(s[a : a + len(item)]) & Counter(item)).values())
            want[d] = max(want.get(d, 0), both / (2 * len(item) - both))
    for d, x in want.items():
        if x >= 0.8:
            near["0.80-0.85" if x < 0.85 else "0.85-1"].add((d, d % 150))
    table = spark.createDataFrame(list(items.items()), "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.matches(frame(spark, docs), table).collect()}
    assert found <= near["0.80-0.85"] | near["0.85-1"]
    for band, pairs in near.items():
        assert len(pairs) >= 20 and len(found & pairs) >= 0.9 * len(pairs), (band, len(found & pairs), len(pairs))
    # what a window meets in the table of blocks is far below the items of its size
    codes, _ = decontamination.known_items(table)
    one = codes.select(F.explode(decontamination.blocks(F.col("g"), 4, 3)).alias("b"))
    met = codes.select("item", F.explode(decontamination.blocks(F.col("g"), 4)).alias("b")).join(one, "b").count()
    assert met / 150 < 0.2 * 150
    equal = spark.createDataFrame([(k, items[0]) for k in range(2000)], "item_id long, text string")
    assert decontamination.known_items(equal)[0].count() == 1
    assert {r["item_id"] for r in decontamination.matches(frame(spark, {0: items[0]}), equal).collect()} == set(range(2000))


def test_texts_of_megabytes(spark, tmp_path):
    r = random.Random(2)
    long = " ".join(f"{r.choice('bcdfgh')}{r.choice('aeiou')}{r.choice('lmnrst')}{r.choice('aeiou')}{r.randint(0, 99)}" for _ in range(200_000))
    docs = {1: long, 2: long[:1000], 3: "a short one", 4: long}
    df = frame(spark, docs)
    n = len(split(long))
    assert {r["doc_id"]: r["n_removed"] for r in substring_dedup.dedup(df).collect()} == {1: 0, 2: len(split(long[:1000])) - (0 if long[1000] == " " or long[999] == " " else 1), 3: 0, 4: n}
    assert {r["doc_id"]: r["component_id"] for r in jaccard_join.join(df).collect()} == {1: 1, 2: 2, 3: 3, 4: 1}
    assert quality_rules.judge(df).where("doc_id = 1").first()["n_words"] == n
    assert token_counts.count_tokens(df, packing.vocabulary_path()).where("doc_id = 4").first()["n_words"] == n
    assert packing.packed(df).where("doc_id = 1").agg(F.sum("length")).first()[0] == packing.packed(df).where("doc_id = 1").first()["doc_tokens"]
    assert line_dedup.clean(df).where("doc_id = 1").first()["text"] == long
    assert license_scan.scan(df).where("size(licenses) > 0").isEmpty()
    assert language_id.identify(df).count() == 4
    items = spark.createDataFrame([(0, " ".join(split(long)[150_000:150_060]))], "item_id long, text string")
    assert {r["doc_id"] for r in decontamination.matches(df, items).collect()} == {1, 4}
