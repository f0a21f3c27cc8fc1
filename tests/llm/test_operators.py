"""The corpus operators against brute force on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioframe.llm import components as C
from folioframe.llm import decontamination, exchange, jaccard_join, language_id, license_scan, line_dedup, packing, quality_model, quality_rules, substring_dedup, textnp, token_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, token string, a long"


def corpus(seed: int = 1, n: int = 60) -> dict[int, str | None]:
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(150)]
    prose = lambda k: " ".join(r.choice(words) + r.choice(["", "", ".", ",", "\n"]) for _ in range(k))
    out: dict[int, str | None] = {i: prose(r.randint(1, 120)) for i in range(n)}
    for i in range(0, n, 4):
        out[n + i] = out[i]  # exact copies
        out[2 * n + i] = (out[i] or "") + " " + prose(2)  # near copies
        out[3 * n + i] = prose(10) + " " + (out[i + 1] or "") + " " + prose(10)  # shared passages
    out |= {900: None, 901: "", 902: " \n\t ", 903: "one", 904: "Two\x0bwords", 905: prose(3000), 906: "é ü ñ 한글 – №", 907: " x y z"}
    return out


def frame(spark, docs: dict[int, str | None], lang=lambda i: "en"):
    return spark.createDataFrame([(i, t, lang(i), "s", len(t or ""), 0.0, "t", 1) for i, t in docs.items()], SCHEMA).repartition(3)


def split(t: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_word_spans_and_hashes():
    import pyarrow as pa

    texts = ["a bb", None, "", "bb a\tbb", "\n", "x" * 3000 + " a"]
    raw, off = textnp.buffer_of(pa.array(texts))
    s, e, before = textnp.word_spans(raw, off)
    got = [raw[a:b].tobytes().decode() for a, b in zip(s, e, strict=True)]
    assert got == [w for t in texts for w in split(t)]
    assert np.diff(before).tolist() == [len(split(t)) for t in texts]
    h = textnp.word_hashes(raw, s, e)
    assert (len(set(h.tolist())), h[1], h[0]) == (len(set(got)), h[2], h[3])
    for v in (np.array([], np.uint64), np.array([3, 3, 9, 1 << 40], np.uint64)):
        assert exchange.unpack_sorted(exchange.pack_sorted(v)).tolist() == v.tolist()


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    docs = corpus()
    rows = packing.packed(frame(spark, docs)).collect()
    tok = Tokenizer.from_file(packing.vocabulary_path())
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert by_doc.keys() == docs.keys() and sorted(by_seq) == list(range(len(by_seq)))
    for i, t in docs.items():
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        got = b"".join(r["ids"] for r in sorted(by_doc[i], key=lambda r: r["start"]))
        assert np.frombuffer(got, "<u4").tolist() == ids and by_doc[i][0]["doc_tokens"] == len(ids)
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= packing.WINDOW
    assert packing.packed(frame(spark, {})).count() == 0


def test_minimum_bin_slack_uses_every_piece():
    r = random.Random(2)
    for _ in range(30):
        counts = {r.randint(1, 64): r.randint(1, 40) for _ in range(r.randint(0, 20))}
        used = Counter()
        for pattern, n in packing.fill(counts, 64):
            assert 0 < sum(k * v for k, v in pattern.items()) <= 64
            for k, v in pattern.items():
                used[k] += v * n
        assert used == Counter(counts)


@pytest.mark.parametrize("seed", [3, 4])
def test_longest_match_against_naive(seed):
    r = random.Random(seed)
    vocab = {"".join(r.choice("abc") for _ in range(r.randint(1, 5))) + r.choice(["", "$"]) for _ in range(40)} | {"a", "b"}
    entry = lambda v: (*v.rstrip("$").encode(), *[token_counts.END_MARK] * v.endswith("$"))
    automaton = token_counts.LongestMatch(map(entry, vocab))

    def naive(word: str) -> int | None:
        rest, n = word + "$", 0
        while rest:
            best = max((v for v in vocab | {"$"} if rest.startswith(v)), key=len, default=None)
            if best is None:
                return None
            rest, n = rest[len(best) :], n + (best != "$")
        return n

    for _ in range(500):
        word = "".join(r.choice("abc") for _ in range(r.randint(1, 14)))
        assert automaton.count((*word.encode(), token_counts.END_MARK)) == naive(word), word


def test_token_counts(spark):
    docs = corpus()
    rows = {r["doc_id"]: r for r in token_counts.count_tokens(frame(spark, docs), packing.vocabulary_path()).collect()}
    assert rows.keys() == docs.keys()
    assert all(rows[i]["n_words"] == len(split(t)) and rows[i]["n_tokens"] >= len(split(t)) and rows[i]["n_unknown"] == 0 for i, t in docs.items())


@pytest.mark.parametrize("batches", [1, 2, 3])
def test_substring_dedup(spark, batches):
    docs = corpus()
    first: dict[tuple, int] = {}
    for i in sorted(docs):
        w = split(docs[i])
        for p in range(len(w) - 12):
            first.setdefault(tuple(w[p : p + 13]), i)
    rows = {r["doc_id"]: r for r in substring_dedup.dedup(frame(spark, docs), batches).collect()}
    assert rows.keys() == docs.keys()
    for i, t in docs.items():
        w = split(t)
        gone = {k for p in range(len(w) - 12) if first[tuple(w[p : p + 13])] < i for k in range(p, p + 13)}
        assert (rows[i]["n_words"], rows[i]["n_removed"]) == (len(w), len(gone))
        assert rows[i]["kept"] == " ".join(x for k, x in enumerate(w) if k not in gone)
    assert substring_dedup.dedup(frame(spark, {}), batches).count() == 0


def test_substring_index_compacts(spark):
    docs = corpus()
    index = substring_dedup.SubstringIndex(spark, fan_in=2)
    for k in range(4):
        index.add(frame(spark, {i: t for i, t in docs.items() if i % 4 == k}))
    assert len(index.runs) <= 2
    again = index.add(frame(spark, docs), keep=False).where("n_words >= 13").agg(F.min(F.col("n_removed") == F.col("n_words"))).first()[0]
    assert again


def test_jaccard_join(spark):
    docs = corpus()
    for k in range(60):  # a group of near copies longer than a short list
        docs[2000 + k] = " ".join(f"w{j}" if j != k else f"z{k}" for j in range(80))
    sets = {i: frozenset(tuple(w[p : p + 4]) for p in range(len(w) - 3)) if len(w) > 3 else frozenset([tuple(w)] if w else []) for i, w in ((i, split(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for i, t in docs.items())}
    root = {i: i for i in docs}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(docs)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and 100 * len(sets[x] & sets[y]) >= 85 * len(sets[x] | sets[y]):
                a, b = sorted((find(x), find(y)))
                root[b] = a
    rows = {r["doc_id"]: r for r in jaccard_join.join(frame(spark, docs)).collect()}
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in rows.items()} == {i: (len(sets[i]), find(i)) for i in docs}
    assert jaccard_join.join(frame(spark, {})).count() == 0


def test_components(spark):
    r = random.Random(5)
    links = [(r.randint(0, 80), r.randint(0, 80)) for _ in range(60)] + [(k, k + 1) for k in range(100, 140)]
    root = {x: x for e in links for x in e}
    for _ in range(200):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["id"]: r["root"] for r in C.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root[x] for x in got} and {x for a, b in links if a != b for x in (a, b)} == got.keys()


def test_quality_rules(spark):
    docs = corpus()
    docs[950] = " ".join(["the same eight words come here again now"] * 9)
    docs[951] = "# * $ % & | < >\na\na\n \n\n"
    rows = {r["doc_id"]: r for r in quality_rules.judge(frame(spark, docs)).collect()}
    assert rows.keys() == docs.keys()
    for i, t in docs.items():
        w, t = split(t), t or ""
        seen = Counter(tuple(w[p : p + 8]) for p in range(len(w) - 7))
        repeat = len({k for p in range(len(w) - 7) if seen[tuple(w[p : p + 8])] > 1 for k in range(p, p + 8)})
        lines = [x for x in t.split("\n") if split(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), repeat)
        r = rows[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, i
        assert r["base_failed"] == (len(w) < 20 or 100 * repeat > 30 * len(w)) and not (r["kept"] and r["base_failed"])
    assert quality_rules.judge(frame(spark, {})).count() == 0


def test_em_prefers_clean_patterns():
    good, bad = (1,) * 6, (-1, -1, -1, 1, 1, 1)
    share, caught, right = quality_rules.estimate([(good, 900), (bad, 100)])
    assert quality_rules.posterior(good, share, caught, right) > 0.9 > 0.1 > quality_rules.posterior(bad, share, caught, right)


def test_language_id(spark):
    tongue = {0: "aeiou bcd", 1: "xyz wqk", 2: "éüß ñçà"}
    r = random.Random(6)
    docs = {i: " ".join("".join(r.choice(tongue[i % 3]) for _ in range(5)) for _ in range(40)) for i in range(240)} | {900: None, 901: "12 !!", 902: ""}
    got = {x["doc_id"]: x for x in language_id.identify(frame(spark, docs, lambda i: None if i % 10 == 0 else "abc"[i % 3])).collect()}
    assert all(got[i]["lang_pred"] == "abc"[i % 3] for i in range(240))
    assert all((got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0) for i in (900, 901, 902))
    held = frame(spark, docs).select("doc_id", language_id.held_out().alias("h")).collect()
    assert all(x["h"] == (zlib.crc32(str(x["doc_id"]).encode()) % 3 == 1) for x in held)
    assert {x["lang_pred"] for x in language_id.identify(frame(spark, docs, lambda i: None)).collect()} == {"und"}


def test_quality_model(spark):
    docs = corpus(7, 200)
    bad = {i for i in docs if i % 5 == 0}
    docs = {i: (re.sub(" ", "### ", t) if i in bad and t else t) for i, t in docs.items()}
    labels = spark.createDataFrame([(i, int(i not in bad)) for i in range(150)], "doc_id long, quality int")
    rows = quality_model.score(frame(spark, docs), quality_model.fit(frame(spark, docs), labels)).collect()
    long = [r for r in rows if len(split(docs[r["doc_id"]])) > 20 and r["doc_id"] < 800]
    assert sum((r["score"] >= 0.5) == (r["doc_id"] not in bad) for r in long) > 0.95 * len(long)
    assert {r["score"] for r in quality_model.score(frame(spark, docs), None).collect()} == {0.5}


def test_quality_model_learns_from_every_label(spark):
    r = np.random.default_rng(4)
    x, y, n = r.normal(0, 1, (3000, 4)), r.integers(0, 2, 3000), r.integers(1, 4, 3000)
    x[:, 0] += 2 * y
    rows = spark.createDataFrame([(int(a), int(b), [float(v) for v in c]) for a, b, c in zip(y, n, x, strict=True)], "_y long, _n long, x array<double>").repartition(5)
    centre, scale, w, threshold, _ = quality_model._fitted(rows, 30, 1e-4)
    whole = np.repeat(x, n, axis=0)
    assert np.allclose(centre, whole.mean(axis=0)) and np.allclose(scale, whole.std(axis=0), atol=1e-5)
    z = np.clip((x - centre) / scale, -6, 6)
    s = np.sort(np.repeat((z * w).sum(axis=1), n))
    k = int(n[y == 0].sum())
    assert np.isclose(threshold, (s[k - 1] + s[k]) / 2, atol=1e-12)
    good, bad, ng, nb = z[y == 1], z[y == 0], n[y == 1], n[y == 0]
    wrong = ng[:, None] * nb[None, :] / (1 + np.exp((good @ w)[:, None] - (bad @ w)[None, :]))
    slope = -(wrong.sum(axis=1) @ good - wrong.sum(axis=0) @ bad) / (ng.sum() * nb.sum()) + 1e-4 * w
    assert np.abs(slope).max() < 3e-3  # of all pairs
    again = quality_model._fitted(rows.repartition(3), 30, 1e-4)
    assert (again[2] == w).all() and again[3] == threshold
    assert quality_model._fitted(rows.where("_y = 1"), 30, 1e-4) is None


def test_line_dedup(spark):
    docs = {i: f"own line {'abcdefghij'[i % 10]}{'klm'[i % 3]} of this document {i}x\nAll rights reserved by the owner {i}\nthe system has logged in user {"nopqrstuvw"[i % 10]} once more\n\ntail {i}{i}" for i in range(24)}
    docs |= {900: None, 901: "", 902: "\n\n"}
    rows = {r["doc_id"]: r for r in line_dedup.clean(frame(spark, docs), min_docs=10).collect()}
    assert rows.keys() == docs.keys()
    assert [rows[i]["_n_dropped"] for i in (0, 900, 901, 902)] == [0, 0, 0, 0] and rows[900]["text"] is None and rows[902]["text"] == "\n\n"
    for i in range(1, 24):
        assert "rights reserved" not in rows[i]["text"] and "has logged in" not in rows[i]["text"]
    assert "rights reserved" in rows[0]["text"] and "has logged in" in rows[0]["text"]
    assert line_dedup.clean(frame(spark, {})).count() == 0


def test_decontamination(spark):
    items = {0: " ".join(f"q{k}" for k in range(30)), 1: "Short one", 2: None, 3: " ".join(f"r{k}" for k in range(12))}
    docs = {0: "before it " + items[0].upper() + " after it.", 1: " ".join(f"q{k}" for k in range(3, 30)) + " tail", 2: " ".join(f"q{k}" for k in range(10)), 3: "Short one", 4: None, 5: "", 6: items[3] + " and more " + items[0], 7: "clean " * 40}
    rows = decontamination.matches(frame(spark, docs), spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == {(0, 0), (1, 0), (6, 0), (6, 3)}
    assert {(r["doc_id"], r["start"], r["similarity"]) for r in rows if r["doc_id"] == 0} == {(0, 2, 1.0)}
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.matches(frame(spark, docs), empty).count() == 0


@pytest.mark.parametrize("parts", [4, 6])
def test_hamming_blocks_lose_no_pair(spark, parts):
    r = random.Random(8)
    rows = [(r.getrandbits(63), m) for m in [[r.randint(0, 63) for _ in range(15)] for _ in range(50)]]
    pairs = [(x, np.int64(np.uint64(x) ^ np.bitwise_or.reduce(np.uint64(1) << np.array(m, np.uint64))).item()) for x, m in rows]
    df = spark.createDataFrame(pairs, "x long, y long").select(decontamination.blocks(F.col("x"), parts).alias("p"), decontamination.blocks(F.col("y"), parts, 15 // parts).alias("q"))
    assert df.where(F.arrays_overlap("p", "q")).count() == len(pairs)


def test_license_scan(spark):
    mit = license_scan.SENTENCES["mit-grant"].replace(" including", "\nincluding") + ".\n\n" + license_scan.SENTENCES["as-is-software"] + "."
    docs = {0: mit, 1: "Some text.\nReleased under the MIT License.\nMore. All rights reserved.", 2: "Nothing here", 3: None, 4: "", 5: "Licensed under CC BY-NC 4.0. Licensed under CC BY-NC 4.0."}
    rows = {r["doc_id"]: (r["identifiers"], r["licenses"]) for r in license_scan.scan(frame(spark, docs)).collect()}
    assert rows[0] == (["mit-grant", "as-is-software"], ["MIT"])
    assert rows[1] == (["mit-under", "reserved"], ["MIT", "LicenseRef-all-rights-reserved"])
    assert rows[2] == rows[3] == rows[4] == ([], []) and rows[5] == (["cc-by-nc-4"] * 2, ["CC-BY-NC-4.0"])


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "jaccard_join", "decontamination", "packing"]
    item = " ".join(f"bench{'abcdefghijklmnopqrstuvwxyz'[k]}" for k in range(20))
    docs = corpus() | {970: "leak of " + item + " here"}
    frame(spark, docs, lambda i: "en" if i % 2 else "de").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().collect()}
    assert not got & {900, 901, 902, 970} and not {60 + i for i in range(0, 60, 4) if len(split(docs[i])) >= 5} & got
    assert {i for i in range(60) if len(split(docs[i])) >= 5 and i % 4} <= got
    assert hashlib.sha256(b"").hexdigest()


def test_line_dedup_hot_and_other_templates(spark, monkeypatch):
    docs = {i: "\n".join([f"seen {i} times in all", "the same line everywhere" if i % 3 else f"own line {'abc'[i % 3]}", f"word{'x' * (i % 2)} here"]) for i in range(40)}
    want = sorted(tuple(r) for r in line_dedup.clean(frame(spark, docs), min_docs=5).select("doc_id", "text", "_n_dropped").collect())
    monkeypatch.setattr(line_dedup, "HOT", 2)
    assert sorted(tuple(r) for r in line_dedup.clean(frame(spark, docs), min_docs=5).select("doc_id", "text", "_n_dropped").collect()) == want
    monkeypatch.setattr(line_dedup, "HOT", 0)
    assert sorted(tuple(r) for r in line_dedup.clean(frame(spark, docs), min_docs=5).select("doc_id", "text", "_n_dropped").collect()) == want
    assert sum(n for _, _, n in want) > 60


def test_lines_of_two_documents(spark, tmp_path):
    import corpus_pipeline

    line = "the very same sentence stands in both of them"
    docs = {1: f"alpha beta gamma delta\n{line}\nshort one", 2: f"other words of this document\n{line}\nshort one", 3: "a 17 b 18 c\nrow 1 2 3 4 5 6 7 8", 4: "a 19 b 20 c\nrow 2 3 4 5 6 7 8 9", 5: line, None: f"{line}\nand more of it here"}
    rows = {r["doc_id"]: r for r in line_dedup.without_repeats(frame(spark, docs)).collect()}
    assert {i: r["_n_dropped"] for i, r in rows.items()} == {1: 0, 2: 1, 3: 0, 4: 0, 5: 1, None: 1}
    assert rows[1]["text"] == docs[1] and rows[2]["text"] == "other words of this document\nshort one"
    spark.createDataFrame([(0, "x y")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left = {r["doc_id"]: r["text"] for r in corpus_pipeline.decontaminated(spark, frame(spark, docs), str(tmp_path)).collect()}
    assert left == {i: r["text"] for i, r in rows.items() if i != 5}


def test_null_ids_and_repeated_rows(spark):
    import corpus_pipeline

    text = lambda w, n=60: " ".join(f"{w}{'abcdefghij'[k % 10]}{'klmnop'[k // 10]}" for k in range(n))
    rows = [(None, text("u")), (None, text("v")), (None, text("v") + " more"), (7, text("w")), (7, text("w")), (None, text("w") + " end"), (8, text("x")), (8, text("y")), (None, text("z")), (None, text("z")), (9, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.0, "t", 1) for i, t in rows], SCHEMA).repartition(3)
    stay = corpus_pipeline.near_duplicates(spark, docs, "")
    kept = [(r["doc_id"], r["text"]) for r in stay.collect()]
    assert stay.columns == docs.columns and len(kept) == len(set(kept))
    want = {rows[0], rows[3], rows[6], rows[7], rows[8], rows[10], rows[11]}
    assert want <= set(kept) and len(set(kept) - want) == 1 and set(kept) - want <= {rows[1], rows[2]}
    joined = sorted((r["doc_id"] or 0, r["n_shingles"], r["class_id"] or 0, r["component_id"] or 0) for r in jaccard_join.join(docs).collect())
    assert joined == sorted([(0, 57, 0, 0), (0, 57, 0, 0), (0, 58, 0, 0), (7, 57, 7, 7), (7, 57, 7, 7), (0, 58, 0, 7), (8, 57, 8, 8), (8, 57, 8, 8), (0, 57, 0, 0), (0, 57, 0, 0), (9, 0, 9, 9), (0, 0, 0, 0)])


def test_substring_dedup_decides_by_80_bits(spark):
    assert substring_dedup.BITS == 48 and substring_dedup.SubstringIndex(spark).check == "<u4"
