"""Operators on small hostile tables, against brute force, round trips and held-out accuracy."""

import base64
import collections
import hashlib
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fathom.llm import chat, decontaminate, language_id, licenses, neardup, packed_ids, packing, quality_model, quality_rules, queries, store, tokens, warc

UPPER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
DATA = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i}" for i in range(30_000))
TEXTS = [None, "", " \t\n", "a", "one two", "one two", LONG, LONG + " x", "é İ ß 日本", "a  b\n\n c", "<|endoftext|> x", "don't 12,3!! a_b\x1c q"]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and long texts, repeated rows, and columns named like the operators' own."""
    rows = [(i, t, None if i % 3 else "en", None if i % 4 == 0 else f"s{i % 2}", None, "x", 0.5) for i, t in enumerate(TEXTS)]
    rows += [rows[4], (None, "one two", "en", "s0", None, "x", 0.5)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, score double")


def docs_of(spark, texts, source="s"):
    return spark.createDataFrame([(i, t, "en", source) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")


@pytest.mark.parametrize("kind, name", [("byte", "byte_bpe_50k.json"), ("word", "word_bpe_49k.json")])
def test_ids_are_the_library_s(kind, name):
    e = tokens.encoder(kind, tokens.tokenizer_path(name))
    rng = random.Random(1)
    alphabet = ["a", "B", "I", "̇", "K", "Å", "Σ", "<|ENDOFTEXT|>", "é", "İ", " ", "  ", "\n", "'s", ",", ".", "1", "ß", "日", "́", "<|endoftext|>", "\x85", "_", "ª"]
    texts = [t or "" for t in TEXTS] + ["".join(rng.choices(alphabet, k=30)) for _ in range(500)]
    for t, raw in zip(texts, e.encode(texts)):
        assert np.frombuffer(raw, np.uint16).tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids, t[:60]


@pytest.mark.parametrize("bits", [1, 7, 13, 16, 17, 31])
def test_bits(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1000).astype(np.uint32)
    data = packed_ids.pack(ids, bits)
    assert len(data) == -(-1000 * bits // 8)
    assert np.array_equal(packed_ids.unpack(data, 1000, bits), ids) and np.array_equal(packed_ids.unpack(data, 100, bits, 333), ids[333:433])


def test_packed_ids(spark, odd):
    got = packed_ids.read_packed(packed_ids.with_starts(packed_ids.write_packed(odd, store.work_dir(spark, "t")))).collect()
    t, start = tokens.load(tokens.tokenizer_path("byte_bpe_50k.json")), 0
    want = sorted(((r.doc_id, r.text) for r in odd.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    assert len(got) == len(want)
    for r, (doc, text) in zip(sorted(got, key=lambda r: r.start), want):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


@pytest.mark.parametrize("targets", [None, {"s0": 3, "s1": 1}])
def test_packing(spark, odd, targets):
    got = packing.pack(odd, targets, length=64).collect()
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
        assert r.ids_crc32 == zlib.crc32(np.frombuffer(r.ids, "<u2").astype("<u4").tobytes())
    total = sum(r.length for r in got)
    assert len(sequences) == -(-total // 64)
    for parts in sequences.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 64
    t = tokens.load(tokens.tokenizer_path("word_bpe_49k.json"))
    pieces = collections.defaultdict(dict)
    for r in got:
        if r.doc_id not in (None, 4):
            pieces[r.doc_id][r.start] = r.ids
    for r in odd.filter("doc_id IS NOT NULL AND doc_id <> 4").collect():
        assert np.frombuffer(b"".join(x for _, x in sorted(pieces[r.doc_id].items())), "<u2").tolist() == [*t.encode(r.text or "", add_special_tokens=False).ids, 1]
    assert packing.pack(odd.limit(0)).count() == 0


def test_packing_keeps_shares(spark):
    docs = docs_of(spark, ["a b c d e f g h"] * 300, "x").union(docs_of(spark, ["a b c d e f g h"] * 100, "y"))
    by = collections.Counter()
    for r in packing.pack(docs, length=64).collect():
        by[r.sequence_id, r.source] += r.length
    assert all(abs(n - (48 if s == "x" else 16)) <= 1 for (w, s), n in by.items() if w < max(w for w, _ in by))


def test_warc(spark):
    rows = [(3, "u\r\nx", "same"), (1, None, "same"), (2, "u2", ""), (5, "u", None), (4, "u", "é" * 50_000), (4, "u", "é" * 50_000), (None, "u", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha", F.lit("clash"))
    index = warc.write_archive(pages, store.work_dir(spark, "t"))
    got = [(r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc.read_archive(index, True).collect()]
    digest = lambda x: base64.b32encode(hashlib.sha1(x.encode()).digest()).decode()
    # page 1 has no html and page 2 an empty one: both are empty payloads, and so is that of page 5
    payloads = [(i, h or "") for i, _, h in rows]
    least = {h: min(i for i, x in payloads if x == h and i is not None) for _, h in payloads}
    want = [(i, "response" if least[h] == i else "revisit", None if least[h] == i else least[h], len(h.encode()), digest(h)) for i, h in payloads]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(got, key=key) == sorted(want, key=key)
    some = warc.read_archive(index.filter("offset > 0")).count()
    assert some == index.filter("offset > 0").count()
    assert warc.read_archive(warc.write_archive(pages, store.work_dir(spark, "t"), min_bytes=5)).filter("page_id = 3 AND record_type = 'response'").count() == 1
    assert warc.read_archive(warc.write_archive(pages.limit(0), store.work_dir(spark, "t"))).count() == 0
    assert list(warc.coalesced([(0, 5), (5, 5), (1 << 20, 5)])) == [(0, 10, 2), (1 << 20, (1 << 20) + 5, 1)]


def test_chat(spark):
    rows = [(1, 1, "assistant", "a\\</s>"), (1, 0, "user", None), (1, 1, "assistant", "a\\</s>"), (2, 0, None, "<<ROLE>>"), (2, 1, "tool]", "[INST]"), (None, 0, "system", "s\n"), (3, 0, "user", LONG)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_chat(turns)).collect()}
    by = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[0] or -1, r[1])):
        by[r[0]].append(r)
    for conv, turns_ in by.items():
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns_)
        learned = "".join(r[3] or "" for r in turns_ if r[2] == "assistant")
        assert (got[conv].n_turns, got[conv].turns_sha256) == (len(turns_), hashlib.sha256(said.encode()).hexdigest())
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert not got[1].valid and got[3].valid and not got[2].valid
    assert chat.read_back(chat.format_chat(turns.limit(0))).count() == 0


def test_licenses(spark, odd):
    texts = [None, "", "Released under the MIT License. under the mit license", "Apache License, Version 2.0", "CC BY-NC", "licensed under the GNU General Public License, version 3", "mit license under", "x " * 5000 + "cc by nc"]
    got = {r.doc_id: r for r in licenses.scan_licenses(docs_of(spark, texts)).collect()}
    assert [(r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for _, r in sorted(got.items())] == [
        (0, None, None, "", ""), (0, None, None, "", ""), (2, 1, 5, "mit", "mit"), (1, 0, 0, "apache-2", "apache-2"), (1, 0, 0, "cc-by-nc", "cc-by-nc"), (0, None, None, "", "gpl-3"), (0, None, None, "", ""), (1, 5000, 5000, "cc-by-nc", "cc-by-nc")]
    assert licenses.scan_licenses(odd).count() == odd.count() and licenses.scan_licenses(odd.limit(0)).count() == 0


def test_license_headers(spark):
    header = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
    texts = [header.format("", 3), header.format("", 2), header.format("Lesser ", 2.1), header.format("Affero ", 3), header.format("", 3).split("terms of the ")[1].split(", or")[0], "as published by the Free Software Foundation, GNU General Public License, see version 4 of the Licence"]
    # each lacks words of its template, and what no text has is its rarest word
    texts += ["Redistribution and use in source and binary forms, with or without changes, are permitted provided that the following conditions hold", "Permission is hereby granted, free of charge, to any person obtaining a copy of this program and documentation"]
    got = {r.doc_id: r.labels for r in licenses.scan_licenses(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == ["gpl-3", "gpl-2", "lgpl", "agpl-3", "gpl-3", "", "bsd", "mit"]


def test_license_passages(spark):
    texts = {
        "Permission is hereby granted, free of charge, to any person obtaining a copy of the software and associated docs": "mit",
        "Redistribution and use in source and binary forms, with or without changes, are allowed provided that the following conditions are met": "bsd",
        "GNU GENERAL PUBLIC LICENSE\n Version 3, 29 June 2007": "gpl-3",
        "// SPDX-License-Identifier: Apache-2.0": "apache-2",
        "# SPDX-License-Identifier: GPL-2.0-or-later": "gpl-2",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.": "apache-2",
        "permission free of charge is granted": "",
        "the general public has a licence": "",
    }
    got = {r.doc_id: r.labels for r in licenses.scan_licenses(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == list(texts.values())


def brute_licenses(index, words):
    """Every template at every place; then the passages that no heavier one of another licence covers; then SPDX lines."""
    slack, plain = licenses.SLACK, words
    words = [licenses.SPELLINGS.get(w, w) for w in words]
    inside = lambda low, high, p: any(words[i : i + len(p)] == p for i in range(max(0, low), min(high, len(words)) - len(p) + 1))
    starts, base, passages = [], set(), []
    for (label, text, must, phrase), never in zip(index.templates, licenses.excluded()):
        total = sum(index.weight[w] for w in text)
        for s in range(-len(text), len(words)):
            if phrase:
                if s >= 0 and plain[s : s + len(text)] == text:
                    starts.append(s)
                    base.add(label)
                continue
            end = s + len(text)
            share = sum(index.weight[w] for i, w in enumerate(text) if w in words[max(0, s + i - slack) : max(0, s + i + slack + 1)]) / total
            ok = share >= licenses.ENOUGH and all(inside(s - slack, end + slack, p) for p in must)
            denied = any(inside(s - 5 - slack, s + slack + 2, [b"not", w]) for w in licenses.DENIED)
            if ok and not any(inside(s - slack, end + 2 * slack, p) for p in never) and not denied:
                passages.append((-round(share * total, 9), s, label, end, share))
    left = []
    for _, s, label, end, share in sorted(passages):
        covered = [1 for a, b, other, _ in left if other != label and len(set(range(a, b)) & set(range(s, end))) * 2 > min(b - a, end - s)]
        left += [] if covered else [(s, end, label, share)]
    named = "|".join(sorted({t for _, t in licenses.SPDX}, key=len, reverse=True))
    one = rf"(?:{named})(?: or later| only| later)?(?: with(?: (?!or |and )[^ ]+)+)?"
    lines = re.findall(rf"(?<![^ ])spdx license identifier ((?:{one}(?: (?:or|and) (?={named}))?)+)(?![^ ])", b" ".join(words).decode())
    spdx = {label for line in lines for label, t in licenses.SPDX if t in re.findall(rf"(?<![^ ])(?:{named})(?![^ ])", line)}
    best = 1.0 if base else max((x[3] for x in left), default=0.0)
    return len(starts), min(starts, default=None), max(starts, default=None), base, base | {x[2] for x in left} | spdx, best


def test_licenses_against_brute_force():
    rng = random.Random(7)
    index = licenses.Index(9, {w: rng.randint(0, 9) for _, words, _, _ in licenses.templates() for w in words})
    for n in range(300):
        text = []
        for _ in range(rng.randint(0, 3)):
            words = rng.choice(index.templates)[1]
            text += [rng.choice([b"x", b"license", b"the", b"not", b"licensed"])] * rng.randint(0, 5) + rng.choice([[], [b"not"]]) + [w for w in words for w in ([w] if rng.random() < 0.9 else [] if rng.random() < 0.5 else [w, b"y"])]
            text += rng.choice([[], [], [b"or", b"mit"], [b"licence"], [b"and", b"gpl", b"2", b"0", b"or", b"later"]])
        got, want = index.scan(text), brute_licenses(index, text)
        assert got[:5] == want[:5] and abs(got[5] - want[5]) < 1e-9, text


def repeated(words):
    grams = collections.Counter(zip(words, words[1:], words[2:]))
    return len({i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)})


def test_quality_rules(spark, odd):
    rng = random.Random(2)
    texts = [" ".join(rng.choices("ab", k=rng.randint(0, 90))) for _ in range(60)] + ["a | b | c.\n" * 30, "x!! " * 100]
    for r in quality_rules.judge(odd.union(docs_of(spark, texts).selectExpr("doc_id", "text", "lang", "source", "NULL", "NULL", "NULL"))).collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        lines = [x for x in (r.text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), len(lines) - len(set(lines)), repeated(words))
        assert r.base_failed == (len(words) < 50 or 100 * r.n_repeat_words > 50 * len(words)) and not (r.base_failed and r.kept)
    assert quality_rules.judge(odd.limit(0)).count() == 0


def test_contamination(spark, odd):
    rng = random.Random(3)
    word = lambda: rng.choice("the OF and é cat dog red".split())
    items = [" ".join(word() for _ in range(n)) for n in (2, 3, 7, 10, 15, 40)] + ["", None]
    texts = [" ".join([*(word() for _ in range(30)), *rng.choice(items[2:6]).split()[rng.randint(0, 3) :], *(word() for _ in range(9))]) for _ in range(80)]
    for pick in (items, items[3:]):
        bench = spark.createDataFrame(list(enumerate(pick)), "item_id long, text string")
        docs = odd.select("doc_id", "text").union(docs_of(spark, texts).selectExpr("doc_id + 100", "text"))
        split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
        windows = collections.defaultdict(set)
        for i, t in enumerate(pick):
            w = split(t)
            for k in range(max(0, len(w) - min(10, len(w)) + 1) if w else 0):
                windows[tuple(w[k : k + min(10, len(w))])].add(str(i))
        got = decontaminate.contamination(docs, bench).collect()
        assert len(got) == docs.count()
        texts_of = {r.doc_id: r.text for r in docs.collect()}
        for r in got:
            w, hit, found = split(texts_of[r.doc_id]), set(), set()
            for n in {len(x) for x in windows}:
                for k in range(len(w) - n + 1):
                    if tuple(w[k : k + n]) in windows:
                        hit |= set(range(k, k + n))
                        found |= windows[tuple(w[k : k + n])]
            assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest())
    assert decontaminate.contamination(odd, bench.limit(0)).filter("contaminated").count() == 0


def test_contamination_by_short_items(spark):
    rng = random.Random(5)
    items = [" ".join(f"i{n}x{k}w{j}" for j in range(n)) for n in range(4, 10) for k in range(5)]
    texts = [" ".join([*(f"d{rng.random()}" for _ in range(30)), item, *(f"d{rng.random()}" for _ in range(30))]) for item in items]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(docs_of(spark, texts).select("doc_id", "text"), bench).collect()}
    for i, item in enumerate(items):
        assert (got[i].n_hit, got[i].n_items, got[i].contaminated) == (len(item.split()), 1, True)


def brute_components(rows, words):
    sets, parent = {}, {}
    for doc, text in rows:
        w = (text or "").encode().translate(UPPER).split()
        s = frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()
        sets.setdefault(doc, []).append(s)
        parent[doc] = doc

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if any(s and t and 100 * len(s & t) >= 80 * len(s | t) for s in sets[a] for t in sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates(spark, odd, words):
    rng = random.Random(4)
    base = [rng.choice("abcdefghij") + rng.choice("klmnop") for _ in range(120)]
    texts = [" ".join(w if rng.random() > 0.02 * (i % 5) else "new" + str(i) for w in base) for i in range(60)] + ["lone words here"] * 3
    docs = odd.select("doc_id", "text").union(docs_of(spark, texts).selectExpr("doc_id + 100", "text"))
    want = brute_components([(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None], words)
    got = neardup.near_duplicates(docs, words).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r.component_id, r.kept) == ((want[r.doc_id], want[r.doc_id] == r.doc_id) if r.doc_id is not None else (None, True))
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_like_texts_below_the_similarity_hardly_meet(spark):
    """Texts of one template with words of their own: no links, and sets that the filters keep apart aren't joined."""
    base = [f"t{i}" for i in range(200)]
    texts = [" ".join(base + [f"own{i}w{j}" for j in range(60)]) for i in range(400)]
    near = [" ".join(base + [f"own{i}w{j}" for j in range(60 - i % 2)]) for i in range(6)]  # each near one of the first
    docs = docs_of(spark, texts + near)
    want = brute_components([(r.doc_id, r.text) for r in docs.collect() if r.doc_id < 8 or r.doc_id >= 400], 2)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, 2).collect()}
    assert {i: got[i] for i in want} == want and all(got[i] == i for i in range(8, 400))
    sets = neardup.shingle_sets(docs, store.written(docs.select(F.col("doc_id").alias("id")), "ids"), 2)
    nodes = store.written(docs.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("component")), "nodes")
    assert neardup.crossings(sets, nodes, 80).count() < 100


def test_components_of_a_shuffled_chain(spark):
    ids = list(range(1000))
    random.Random(6).shuffle(ids)
    edges = spark.createDataFrame([*zip(ids, ids[1:]), (2001, 2002), (2003, 2002)], "a long, b long").repartition(4)
    got = {r.id: r.component for r in neardup.components(edges).collect()}
    assert got == {**dict.fromkeys(ids, 0), 2001: 2001, 2002: 2001, 2003: 2001}


def test_language_features():
    """Against plain Python: hashed runs of one to three lower-case letters, a gap wherever there are others."""
    rng = random.Random(8)
    for _ in range(50):
        text = "".join(rng.choices("abÀé 1.日", k=rng.randint(1, 40)))
        runs = "".join(c.lower() if c.isalpha() else " " for c in text)
        runs = f" {' '.join(runs.split())} "
        grams = [runs[i : i + n] for n in (1, 2, 3) for i in range(len(runs) - n + 1) if n > 1 or runs[i] != " "]
        found = language_id.ngrams(text)
        assert found is None if not runs.strip() else (sum(found[1]) == len(grams) and len(found[0]) <= len(set(grams)))
        if found and len(set(grams)) - len(found[0]) <= 1:  # as often as in Python, but where two share a feature
            assert sorted(found[1].tolist())[-1] >= max(collections.Counter(grams).values())


def test_language_id(spark, odd):
    d = spark.read.parquet(f"{DATA}/documents.parquet")
    got = language_id.predict_languages(d).join(d.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)
    hidden = d.withColumn("lang", F.when(language_id.held_out(F.col("doc_id")), "zz").otherwise(F.col("lang")))
    assert language_id.predict_languages(hidden).filter("lang_pred = 'zz'").count() == 0
    for r in language_id.predict_languages(odd).collect():
        text = dict(enumerate(TEXTS)).get(r.doc_id, "one two") or ""
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text)) and 0 <= r.score <= 1
    bare = ["\u2764\ufe0f 123", "1\ufe0f\u20e3", "\u0301 \u0301", "\U0003fffd", "123 456", "\U000323b0"]
    mixed = d.select("doc_id", "text", "lang").union(spark.createDataFrame([(10**6 + i, t, None) for i, t in enumerate(bare)], "doc_id long, text string, lang string"))
    assert {r.lang_pred for r in language_id.predict_languages(mixed).filter("doc_id >= 1000000").collect()} == {"und"}
    assert language_id.predict_languages(odd.limit(0)).count() == 0


def test_quality_model(spark, odd):
    # the smallest tables have about 50 labels to learn from, of which some kinds of junk have none (31 of 35 right)
    d, labels = (spark.read.parquet(f"{DATA}/../sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality_model.quality_scores(d, labels).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) >= 0.97 * len(got)
    rows = quality_model.quality_scores(odd, labels, whole_rows=True)
    assert rows.count() == odd.count() and rows.select("row.*").columns == odd.columns
    assert {r.score for r in quality_model.quality_scores(odd, labels.limit(0)).collect()} == {0.5}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    db = duckdb.connect()
    for t in os.listdir(DATA):
        db.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{DATA}/{t}'")
    cursor = db.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    got = queries.queries()[name](spark, DATA)
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(cursor.fetchall())


def test_stages_on_hostile_rows(spark, odd, tmp_path):
    """Nulls, empty and long texts, repeated rows, no rows, and columns named like the stages' own."""
    clean = " ".join(f"word{i % 97}x{i % 31}, and" for i in range(120)) + "."
    rows = [(20 + i, clean if i % 2 else clean + f" end{i}.", "en", "s0", None, "x", 0.5) for i in range(3)] + [(20, clean, "en", "s0", None, "x", 0.5)] * 2
    docs = odd.union(spark.createDataFrame(rows, odd.schema)).withColumn("_t", F.lit("mine")).withColumn("row", F.lit(1)).withColumn("id", F.lit("a"))
    for stage in (s for _, s in corpus_pipeline.STAGES[:-1]):
        assert stage(spark, docs.limit(0), DATA).count() == 0
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns and {r["_t"] for r in out.collect()} <= {"mine"}
    left = corpus_pipeline.dedup(spark, docs, DATA)
    want = brute_components([(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None], 5)
    assert {r.doc_id for r in left.collect() if r.doc_id is not None} == {i for i, c in want.items() if i == c}
    assert left.filter("doc_id = 20").count() == 2 and left.filter("doc_id = 4").count() == 1  # two texts under 20, one under 4
    assert corpus_pipeline.packing(spark, docs.limit(0), DATA).count() == 0
    packed = corpus_pipeline.packing(spark, docs, DATA).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}


def test_decontamination_stage(spark, tmp_path):
    items = [" ".join(f"i{n}w{j}" for j in range(n)) for n in (4, 7, 9, 12)]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    texts = [f"a b c {t} d e f" for t in items] + ["a b c d e f", None, items[3][: len(items[3]) // 2]]
    kept = corpus_pipeline.decontamination(spark, docs_of(spark, texts), str(tmp_path)).collect()
    assert {r.doc_id for r in kept} == {4, 5, 6}


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = store.written(stage(spark, docs, DATA), name)
        assert out.columns == docs.columns and out.count() > 0
        kept = {r.doc_id for r in out.select("doc_id").collect()}
        if name == "quality_rules":
            assert kept == {r.doc_id for r in quality_rules.judge(docs).filter("kept").collect()}
        if name == "near_dedup":
            want = brute_components([(r.doc_id, r.text) for r in docs.collect()], 5)
            assert kept == {i for i, c in want.items() if i == c}
        assert kept <= ids
        docs, ids = out, kept
    packed = corpus_pipeline.run(spark, DATA).collect()
    assert {r.doc_id for r in packed} == ids


#: A text for each licence, as its users write it, and the labels that it should get; no more and no fewer.
NOTICES = {
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software)": "boost-1",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal": "mit",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "cc-by-sa",
    "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.": "cc-by-nc",
    "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.": "cc-by-nd",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.": "cc-by-nc-sa",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.": "cc-by-nc-nd",
    "This work is licensed under a Creative Commons Attribution 4.0 International License.": "cc-by",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED AS IS": "0bsd",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.": "isc",
    "This file is not licensed under the GNU General Public License version 3": "",
    "SPDX-License-Identifier: MIT OR Apache-2.0": "apache-2,mit",
    "SPDX-License-Identifier: (GPL-2.0-or-later WITH Classpath-exception-2.0) AND BSD-3-Clause": "bsd,gpl-2",
    "SPDX-License-Identifier: GPL-3.0-only\nint main or not": "gpl-3",
    "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nVersion 2": "wtfpl",
    "Licensed under the Apache Licence, Version 2.0 (the Licence); you may not use this file except in compliance with the Licence.": "apache-2",
    "Licensed under the Apache License, Version 2.0. Licensed under the MIT License.": "apache-2,mit",
    "a text of its own that speaks of a license and of the public, free of charge": "",
}


def test_each_notice_has_its_labels(spark):
    """With the weights of these texts, and with even ones."""
    docs = docs_of(spark, [*NOTICES, *(["some other words here"] * 50)])
    got = {r.doc_id: r.labels for r in licenses.scan_licenses(docs).collect()}
    even = licenses.Index(0, {})
    for i, (text, labels) in enumerate(NOTICES.items()):
        assert got[i] == labels, text
        assert ",".join(sorted(even.scan(licenses.words_of(text))[4])) == labels, text


def test_sentences_of_any_script_end(spark):
    """Long lines of prose stay, whatever marks their script has; lines without any, or with signs only, go."""
    words = " ".join(f"w{i}" for i in range(40))
    lines = {words + mark: True for mark in (".", "\u061f", "\u06d4", "\u1362", "\u0589", "\u104b", "\u0964", "\u3002")} | {words: False, words + " don't #x @y": False}
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    assert {r.line: not r.f for r in df.select("line", quality_rules.line_fails(F.col("line")).alias("f")).collect()} == lines


def test_hot_ends_of_pairs(spark):
    """One document of many pairs, on either side, and pairs of its partners."""
    ids = [*range(1, 60)]
    sets = spark.createDataFrame([(i, list(range(10 if i % 7 else 5))) for i in [0, *ids, 99]], "id long, shingles array<long>")
    pairs = [(0, i) for i in ids] + [(i, 99) for i in ids] + [(i, i + 1) for i in ids[:-1]]
    old, neardup.HOT = neardup.HOT, 4
    try:
        got = neardup.confirmed(spark.createDataFrame(pairs, "a long, b long"), sets, 80).collect()
    finally:
        neardup.HOT = old
    small = {i for i in [0, *ids, 99] if i % 7 == 0}
    assert sorted(map(tuple, got)) == sorted((a, b) for a, b in pairs if (a in small) == (b in small))


def test_chat_ignores_clashing_columns(spark):
    plain = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")], "conv_id long, turn long, role string, text string")
    odd = plain.withColumns({c: F.lit("clash") for c in ("formatted", "valid", "loss_spans", "n_turns", "turns")})
    read = lambda t: [r.asDict() for r in chat.read_back(chat.format_chat(t)).collect()]
    assert read(odd) == read(plain) and len(read(plain)) == 1


def test_empty_tables(spark, odd):
    none = odd.limit(0)
    assert packed_ids.read_packed(packed_ids.with_starts(packed_ids.write_packed(none, store.work_dir(spark, "t")))).collect() == []
    labels = spark.createDataFrame([(1, 1, 9), (2, 0, 9)], "doc_id long, quality int, score int")
    assert quality_model.quality_scores(none, labels).collect() == []
    assert quality_model.quality_scores(odd, labels.limit(0)).count() == odd.count()


def test_score_is_the_rules_sum(spark):
    """The column expression of the fitted rules, against adding up the rules that hold in plain Python."""
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    stats = docs.select("doc_id", quality_model.held_out(F.col("doc_id")).alias("held_out"), *(c.alias(n) for n, c in quality_model.statistics(F.coalesce(F.col("text"), F.lit(""))).items()))
    train = stats.filter("NOT held_out").join(labels.filter("quality IN (0, 1)"), "doc_id").select(F.col("quality").cast("double").alias("label"), *quality_model.NAMES)
    intercept, rules = quality_model.fit(store.written(train, "train"))
    expression = sum((F.lit(w) * quality_model.holds(r) for w, r in rules), F.lit(intercept))
    for row in stats.withColumn("total", expression).collect():
        want = intercept + sum(w for w, r in rules if all(low < row[quality_model.NAMES[f]] <= high for f, low, high in r))
        assert abs(row.total - want) < 1e-9
    scores = quality_model.quality_scores(docs, labels).collect()
    assert rules and len(scores) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in scores)
