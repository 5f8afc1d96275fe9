"""Operators against brute force, on small tables with awkward rows."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from vouchlake.llm import exact_dedup, fingerprint, langid, license_scan, mixing, near_dedup, packing, quality, sharding, token_count

P = pytest.importorskip("public_tokenizers")
WORDS = " ".join(f"word{i}" for i in range(60))
ROWS = [
    (1, None, "en", "a"), (2, "", "en", None), (3, "Licensed under the Apache License, Version 2.0.", "en", "a"),
    (4, WORDS, "de", "b"), (5, WORDS, "de", "b"), (6, WORDS + " more", "de", None), (7, "é́  x  y\n\n<|endoftext|> z\t", None, "c"),
    (8, "a" * 5000 + " " + "long text " * 3000, "en", "a"), (9, "!!! ???", "en", "a"), (9, "!!! ???", "en", "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string, size string, kept string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "clash", "clash") for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact(spark, docs, none):
    got = exact_dedup.exact_dedup(spark, docs).collect()
    groups = defaultdict(list)
    for r in ROWS:
        groups[r[1] or ""].append(r[0])
    assert len(got) == len(ROWS)
    for r in got:
        mine = next(v for v in groups.values() if r["doc_id"] in v)
        assert (r["keep_id"], r["group_size"], r["kept"]) == (max(mine), len(mine), r["doc_id"] == max(mine))
    assert exact_dedup.exact_dedup(spark, none).count() == 0
    assert sorted(r["doc_id"] for r in exact_dedup.keep_first_copies(spark, docs).collect()) == sorted(max(v) for v in groups.values())


def test_index_keeps_earlier_batches(spark, docs, tmp_path):
    index = exact_dedup.DigestIndex(spark, f"file://{tmp_path}/index", 4)
    exact_dedup.exact_dedup(spark, docs.where("doc_id = 4"), index=index).count()
    got = exact_dedup.exact_dedup(spark, docs.where("doc_id = 5"), index=index).first()
    assert (got["keep_id"], got["kept"], index.read().count()) == (4, False, 1)


def test_rows_that_share_an_id_are_judged_by_their_text(spark):
    rows = spark.createDataFrame([(5, "A"), (7, "A"), (5, "B"), (5, "B"), (None, "C")], "doc_id long, text string")
    got = sorted(map(tuple, exact_dedup.keep_first_copies(spark, rows).collect()), key=str)
    assert got == [(5, "B"), (7, "A"), (None, "C")]


def test_index_opens_as_it_was_written(spark, tmp_path):
    rows = spark.range(200).selectExpr("id doc_id", "concat('text ', id) text")
    path = f"file://{tmp_path}/index"
    exact_dedup.exact_dedup(spark, rows, index=exact_dedup.DigestIndex(spark, path, 4)).count()
    spark.sql(f"DROP TABLE {exact_dedup.DigestIndex(spark, path).table}")  # as a later session finds it
    index = exact_dedup.DigestIndex(spark, path, 8)
    assert (index.buckets, index.read().count()) == (4, 200)
    got = exact_dedup.exact_dedup(spark, rows.selectExpr("doc_id + 1000 doc_id", "text"), index=index)
    assert got.where("kept or keep_id >= 200").count() == 0 and index.read().count() == 200
    index.compact(8)
    again = exact_dedup.DigestIndex(spark, path, 2)
    assert (again.generation, again.buckets, again.read().count()) == (2, 8, 200)


def test_near(spark, docs, none):
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(spark, docs).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 4, 7: 7, 8: 8, 9: 9}
    assert near_dedup.near_duplicates(spark, none).count() == 0


def test_signature_estimates_probability_jaccard():
    rng = np.random.default_rng(1)
    x = rng.integers(1, 1 << 62, 400).astype(np.uint64)
    est = [np.mean(near_dedup.signature(np.sort(x[:300] + np.uint64(s)), np.ones(300)) == near_dedup.signature(np.sort(x[100:] + np.uint64(s)), np.ones(300))) for s in range(40)]
    assert abs(np.mean(est) - 0.5) < 0.05


def test_fingerprint(spark, docs, none):
    once = docs.dropDuplicates(["doc_id"])
    text = {r[0]: r[1] or "" for r in ROWS}
    ids = sorted(text, reverse=True)
    got = {r["doc_id"]: r for r in fingerprint.compare_with_next(spark, once).collect()}
    for i, a in enumerate(ids):
        e = fingerprint.edited(text[a], text[ids[(i + 1) % len(ids)]])
        assert got[a]["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        assert got[a]["fingerprint"] == fingerprint.fingerprint(text[a])
    assert fingerprint.compare_with_next(spark, none).count() == 0


def test_sharding(spark, docs, none):
    got = sharding.shard(spark, docs).collect()
    assert len(got) == len(ROWS)
    per = defaultdict(list)
    for r in got:
        per[r["shard"]].append(r["slot"])
        assert r["text_crc32"] in {zlib.crc32((x[1] or "").encode()) for x in ROWS if x[0] == r["doc_id"]}
    assert all(sorted(v) == list(range(len(v))) for v in per.values())
    assert sharding.shard(spark, none).count() == 0


def test_rebalance_moves_little():
    sizes = {(i, 0, 0): 10 for i in range(100)}
    old = sharding.assign(sizes, 4)
    new = sharding.rebalance(old, sizes | {(0, 0, 0): 100}, 4)
    assert sum(old[u] != new[u] for u in old) < 20


def test_shards_are_balanced_and_groups_stay_whole(spark, tmp_path):
    rows = [(i, f"text {i} " + "x" * (i * 37 % 300)) for i in range(6000)]
    rows += [(10_000 + i, "whole " * 10) for i in range(700)]  # fits one shard of 16
    rows += [(20_000 + i, "too large for one shard " * 10) for i in range(2000)]
    first = [*rows, (30_000, None), (30_001, "")]
    path = f"file://{tmp_path}/map"
    got = sharding.shard(spark, spark.createDataFrame(first, "doc_id long, text string"), map_path=path).collect()
    load, slots, by_text, text = defaultdict(int), defaultdict(list), defaultdict(set), dict(first)
    for r in got:
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        by_text[text[r["doc_id"]] or ""].add(r["shard"])
        assert r["size"] == len((text[r["doc_id"]] or "").encode()) + 1
    assert len(got) == len(first) and set(load) == set(range(16)) and max(load.values()) < 1.01 * min(load.values())
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert [t for t, s in by_text.items() if len(s) > 1] == ["too large for one shard " * 10]
    # the next version, with more rows, moves few of the old ones
    more = [*first, *[(40_000 + i, f"more {i} " * 20) for i in range(500)]]
    then = {r["doc_id"]: r for r in sharding.shard(spark, spark.createDataFrame(more, "doc_id long, text string"), map_path=path).collect()}
    old = {r["doc_id"]: r["shard"] for r in got}
    assert {r["map_version"] for r in then.values()} == {2} and sharding.SlotMap(spark, path).versions() == [1, 2]
    assert sum(then[d]["shard"] != s for d, s in old.items()) < 0.15 * len(old)


def test_language(spark, docs, none):
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(spark, docs, langid.learn(docs)).collect()}
    assert got[1] == got[2] == got[9] == "und" and got[5] == "de"
    assert langid.identify(spark, none, langid.learn(none)).count() == 0


def test_tokens(spark, docs, none):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    full = Tokenizer.from_file(path)
    got = token_count.count_tokens(spark, docs, path).collect()
    want = sorted((r[0], len((r[1] or "").encode()), len(full.encode(r[1] or "").ids)) for r in ROWS)
    assert sorted((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert token_count.count_tokens(spark, none, path).count() == 0


def test_packing(spark, docs, none):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    full = Tokenizer.from_file(path)
    got = packing.pack(spark, docs.dropDuplicates(["doc_id"]).repartition(2), path).collect()
    per, seq = defaultdict(list), defaultdict(list)
    for r in got:
        per[r["doc_id"]].append(r)
        seq[r["sequence_id"]].append(r)
    for doc, text in {r[0]: r[1] or "" for r in ROWS}.items():
        ids, at = np.array([*full.encode(text, add_special_tokens=False).ids, 2], "<u4"), 0
        for r in sorted(per[doc], key=lambda r: r["start"]):
            assert (r["start"], r["ids_crc32"], r["doc_tokens"]) == (at, zlib.crc32(ids[at : at + r["length"]].tobytes()), len(ids))
            at += r["length"]
        assert at == len(ids)
    for rs in seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
    assert packing.pack(spark, none, path).count() == 0


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(3, 1), (4, 1), (9, 0)], "doc_id long, quality int")
    assert quality.score(spark, docs, labels).count() == len(ROWS)
    assert quality.score(spark, none, labels.limit(0)).count() == 0


def test_quality_without_labels_keeps_all(spark, docs):
    for rows in ([], [(3, 1), (4, 1), (5, None)]):
        got = quality.score(spark, docs, spark.createDataFrame(rows, "doc_id long, quality int")).collect()
        assert len(got) == len(ROWS) and {(r["quality"], r["keep"]) for r in got} == {(0.5, True)}


def test_quality_against_a_plain_version(spark):
    rnd = np.random.default_rng(9)
    good, bad = [[f"{s}{x}" for x in ("ab", "cd", "ef", "gh", "ij", "kl")] for s in ("fine", "junk")]
    rows = [(i, " ".join(rnd.choice(good if i % 3 else bad, 8)), "en", f"s{i % 4}") for i in range(900)]
    labels = [(i, int(i % 3 > 0)) for i in range(0, 900, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in quality.score(spark, docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert np.mean([got[i]["keep"] == (i % 3 > 0) for i in range(900) if i % 4]) > 0.97
    # the lexical score by hand: log odds of present features, per group over the root of their number
    at, odds = (0, 3, 6), np.array([1.0, 2.0, 4.0, -1.0, 0.5, 8.0])
    view = quality.View(at, odds, np.array([0.5, 2.0, 0.25]))
    sets = [np.array(x, np.uint16) for x in ([0, 2, 4], [3, 5], [])]
    plain = []
    for x in sets:
        parts = [[odds[i] for i in x if lo <= i < hi] for lo, hi in ((0, 3), (3, 6))]
        plain.append(sum(w * sum(p) / max(1, len(p)) ** 0.5 for w, p in zip((0.5, 2.0), parts)) + 0.25)
    assert np.allclose(view.logit(sets), plain)


def test_quality_counts_of_a_view():
    counts, n = quality.counted((0, 4), [np.array([0, 2]), np.array([2, 3]), np.array([2])], np.array([1, 0, 1]))
    assert counts.tolist() == [[0, 0, 1, 1], [1, 0, 2, 0]] and n.tolist() == [1, 2]


def test_language_of_number_signs_is_undetermined(spark, docs):
    rows = spark.createDataFrame([(1, "\u00bd \u00b2"), (2, "\u2167"), (3, "\u00b2 word1 word2")], "doc_id long, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(spark, rows, langid.learn(docs)).collect()}
    assert got[1] == got[2] == "und" and got[3] != "und"


def test_licenses(docs, none):
    got = {r["doc_id"]: r["licenses"] for r in license_scan.scan(docs).collect()}
    assert got[3] == "Apache-2.0" and got[1] == got[8] == ""
    assert license_scan.scan(none).count() == 0


def test_mixing(spark, docs, none):
    got = mixing.mix(spark, docs).collect()
    assert len(got) == len(ROWS) and all(r["taken"] <= 3 * r["size"] for r in got)
    total = sum(len((r[1] or "").split()) for r in ROWS)
    assert abs(sum(r["taken"] for r in got) - total) <= 4
    assert mixing.mix(spark, none).count() == 0


def test_mixing_against_a_plain_version(spark):
    rnd = np.random.default_rng(1)
    rows = [(i, None if i % 50 == 0 else "w " * int(rnd.integers(0, 30)), None if i % 7 == 0 else f"s{int(rnd.integers(0, 10) ** 2 // 25)}") for i in range(3000)]
    got = mixing.mix(spark, spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    size, source = {i: len((t or "").split()) for i, t, _ in rows}, {i: s for i, _, s in rows}
    total, mine = sum(size.values()), defaultdict(int)
    for i, n in size.items():
        mine[source[i]] += n
    order = sorted(mine, key=lambda s: (s is None, s or ""))
    weight, want, left = {s: k % 3 + 1 for k, s in enumerate(order)}, {}, dict.fromkeys(order)
    rest = total
    while left:
        unit = rest / sum(weight[s] for s in left)
        over = [s for s in left if weight[s] * unit > 3 * mine[s]]
        for s in over or list(left):
            want[s] = 3 * mine[s] if over else weight[s] * unit
            del left[s]
        rest = total - sum(want.values())
    taken = defaultdict(int)
    for r in got:
        taken[source[r["doc_id"]]] += r["taken"]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == mine[source[r["doc_id"]]]
        assert abs(r["target"] - want[source[r["doc_id"]]]) < 1e-6 and r["taken"] <= 3 * r["size"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in order)


def test_language_margin_does_not_depend_on_length(spark):
    rnd = np.random.default_rng(3)
    stock = {lang: ["".join(rnd.choice(list("aeioubcdfgklmnprst"), 6)) for _ in range(100)] for lang in ("xx", "yy")}
    text = lambda lang, n: " ".join(rnd.choice(stock[lang], n))
    learned = langid.learn(spark.createDataFrame([(i, text(lang, 20), lang) for i in range(120) for lang in stock], "doc_id long, text string, lang string"))
    rows = [(1, text("xx", 1_000_000)), (2, text("yy", 1_000_000)), (3, text("xx", 200)), (4, "qq")]
    rows += [(5 + i, f"{text('xx', 1)[:5]} {text('yy', 1)[:5]} z{i}") for i in range(300)]
    got = {r["doc_id"]: r for r in langid.identify(spark, spark.createDataFrame(rows, "doc_id long, text string"), learned).collect()}
    assert [(got[i]["lang_pred"], got[i]["rejected"]) for i in (1, 2, 3)] == [("xx", False), ("yy", False), ("xx", False)]
    near = [r["rejected"] for r in got.values() if r["score"] < 0.8]  # a lead of one byte or none
    assert len(near) > 9 and all(near)


LICENSED = {
    "MIT License\n\nCopyright (c) 2020 X\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n": "MIT",
    "The code is released under the MIT License.": "MIT",
    "// SPDX-License-Identifier: MIT\nint x;": "MIT",
    "# Licensed under the Apache License, Version 2.0 (the \"License\");\n# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at\n#\n#   http://www.apache.org/licenses/LICENSE-2.0\n": "Apache-2.0",
    " * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version.\n": "GPL-3.0-or-later",
    "This program is free software; you can redistribute it and/or\nmodify it under the terms of the GNU General Public License\nas published by the Free Software Foundation; version 2\nof the License.": "GPL-2.0",
    "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.": "LGPL-2.1-or-later",
    "Foo is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": "AGPL-3.0-or-later",
    "This program is free software. You should have received a copy of the GNU General Public License along with this program.": "GPL",
    "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution.\n\n": "BSD-2-Clause",
    "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.": "MPL-2.0",
    "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.": "ISC",
    "This is free and unencumbered software released into the public domain.": "Unlicense",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "CC-BY-SA-4.0",
    "some words\nLicensed under CC0 1.0\nmore words": "CC0-1.0",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "This file is not licensed under the MIT License.": "", "He said that this is licensed under the MIT License.": "", "This program is free software.": "",
    "The license of MIT students was permission.": "",
}


def test_licence_texts_and_notices(spark):
    bsd = next(t for t, x in LICENSED.items() if x == "BSD-2-Clause")
    more = {bsd + "3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.\n": "BSD-3-Clause"}
    rows = list(enumerate((LICENSED | more).items()))
    got = {r["doc_id"]: r["licenses"] for r in license_scan.scan(spark.createDataFrame([(i, t) for i, (t, _) in rows], "doc_id long, text string")).collect()}
    assert [(t, got[i]) for i, (t, want) in rows if got[i] != want] == []


def test_every_licence_identifier_is_in_a_rule():
    table = license_scan.SENTENCES.values()
    names = getattr(license_scan, "NAMES", {})
    assert {*table, *names} == {i for rule, _ in license_scan.RULES for i in rule}


def test_every_licence_text_is_looked_at():
    import re

    spoken = [s.replace("|", " ") for s in license_scan.SENTENCES] + [f"released under the {n}" for ns in license_scan.NAMES.values() for n in ns]
    assert [s for s in spoken if not re.search(license_scan.TRIGGER, s)] == []


def test_recall_of_near_copies_by_kind_of_edit(spark):
    rnd, rows, kinds = np.random.default_rng(8), [], []
    new = lambda: f"n{rnd.integers(10**9)}"
    edits = {
        "last line 50 times": lambda ls: [*ls, *[ls[-1]] * 49],
        "first line 10 times": lambda ls: [*[ls[0]] * 10, *ls],
        "a word replaced": lambda ls: [*ls[:3], new() + ls[3][ls[3].index(" "):], *ls[4:]],
        "a line at the end": lambda ls: [*ls, " ".join(new() for _ in range(8))],
        "first line gone": lambda ls: ls[1:],
        "capitals and marks": lambda ls: [x.upper() + " !" for x in ls],
    }
    for kind, edit in edits.items():
        for _ in range(60):
            lines = [" ".join(new() for _ in range(8)) for _ in range(12)]
            rows += [(len(rows), "\n".join(lines)), (len(rows) + 1, "\n".join(edit(lines)))]
            kinds.append(kind)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    alike, caught, wrong = defaultdict(int), defaultdict(int), []
    for g, kind in enumerate(kinds):
        a, b = (set(near_dedup.Shingler()(rows[2 * g + i][1])[0].tolist()) for i in (0, 1))
        if len(a & b) >= 0.8 * len(a | b):
            alike[kind] += 1
            caught[kind] += got[2 * g] == got[2 * g + 1]
        elif got[2 * g] == got[2 * g + 1]:
            wrong.append(g)
    assert set(alike) == set(edits) and all(caught[k] >= 0.95 * n for k, n in alike.items()) and not wrong


def test_near_duplicates_of_rows_that_share_an_id(spark):
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(1, text), (1, "other words of the same id"), (2, text), (3, text + " more"), (4, None), (4, None)]
    got = {(r["doc_id"], r["class_id"]) for r in near_dedup.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {c for d, c in got if d in (2, 3)} == {min(c for d, c in got if d in (2, 3))} and {(d, c) for d, c in got if d == 4} == {(4, 4)} and len(got) == 4


def test_near_copies_with_other_repeat_counts(spark):
    rnd, rows = np.random.default_rng(5), []
    for g in range(30):
        base, passage = [" ".join(f"g{g}w{x}" for x in rnd.integers(0, 10**6, n)) for n in (84, 24)]
        rows += [(2 * g, f"{base} {passage}"), (2 * g + 1, " ".join([base, *[passage] * 50]))]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = [set(near_dedup.Shingler()(t)[0].tolist()) for _, t in rows]
    alike = [g for g in range(30) if len(sets[2 * g] & sets[2 * g + 1]) >= 0.8 * len(sets[2 * g] | sets[2 * g + 1])]
    assert len(alike) == 30 and got == {i: i - i % 2 for i in range(60)}
