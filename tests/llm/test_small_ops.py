"""Operators on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from conftest import same_rows
from pyspark.sql import functions as F

from atlasforge.llm import bagminhash, license_rules, line_dedup, pfair, phrase_index, quality, queries, quote_threads, token_store, toxicity, webp
from atlasforge.llm.common import Words, text_slices

DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, ids string, key string, digest string"


def docs(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or ["a"] * len(texts))[i], len(t or ""), "x", "y", "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


LONG = " ".join(f"w{i % 977}" for i in range(60_000))
ODD = [None, "", " \n ", "one", "Ünï cödé", "a b c d e f g h", "a b c d e f g h", LONG, "\0 null \x7f byte", "...", "one"]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_duckdb(spark, duck, name):
    same_rows(queries.QUERIES[name](spark, DIR), duck.sql(queries.ORACLES[name]))


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - {"op1_quote_threads", "op11_prefix_trie", "op12_spelling_variants"}))
def test_odd_and_empty_tables(spark, tmp_path, name):
    """Every query over odd texts, and over empty tables."""
    labels = spark.createDataFrame([(i, i % 2 if i % 3 else None, (i + 1) % 2) for i in range(11)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "a b c d e f g h"), (2, None), (3, ""), (4, "one"), (1, "cödé")], "item_id long, text string")
    for kind, n in (("odd", 11), ("empty", 0)):
        d = tmp_path / kind
        docs(spark, ODD).limit(n).write.parquet(str(d / "documents.parquet"))
        labels.limit(n).write.parquet(str(d / "labels.parquet"))
        bench.limit(n).write.parquet(str(d / "benchmark.parquet"))
        got = queries.QUERIES[name](spark, str(d)).toPandas()
        assert len(got) == n and (n == 0 or sorted(got.doc_id) == list(range(11)))


def words(text):
    for _, data, offs in text_slices(__import__("pyarrow").array([text])):
        w = Words(data, offs)
        return [bytes(w.low[a:b]).decode() for a, b in zip(w.starts, w.ends, strict=True)]
    return []


# ---------------------------------------------------------------- op1


def test_threads_like_sql(spark):
    import duckdb

    r = random.Random(5)
    vocabulary, rows = "alpha beta gamma delta eps zeta eta theta".split(), []
    for c in range(5):
        texts = []
        for t in range(30):
            own = "\n".join(" ".join(r.choice(vocabulary) for _ in range(r.randint(1, 4))) + r.choice(["", "!"]) for _ in range(r.randint(0, 3)))
            src = r.choice(texts) if texts and r.random() < 0.6 else ""
            text = ("\n".join(r.choice(["> ", ">", " > "]) + x for x in src.split("\n")) + "\n" if src else "") + own
            texts.append(text)
            if r.random() < 0.9:
                rows.append((c, t * 2, r.choice(["user", "assistant"]), text if r.random() < 0.95 else None))
        rows.append(rows[-1])
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    pdf = df.toPandas()
    con = duckdb.connect()
    con.register("pp", pdf)
    con.sql("create view conversations as select * from pp")
    piece, quote_threads.PIECE = quote_threads.PIECE, 8
    try:
        got = quote_threads.threads(df).withColumn("quoted_turns", F.array_join("quoted_turns", ","))
        same_rows(got, con.sql(queries.ORACLES["op1_quote_threads"]))
    finally:
        quote_threads.PIECE = piece


def test_quotes_wrapped_anew_and_parts_of_passages(spark):
    long = "The first sentence of this message is here. The second one follows it\nand goes on over two lines! A third, short one."
    rows = [
        (1, 1, "user", long),
        (1, 2, "assistant", "Something else entirely."),
        (1, 3, "user", "> The first sentence of this\n> message is here. The second one follows it and goes\n> on over two lines! A third, short one.\nWrapped anew."),
        (1, 4, "assistant", "> the second one follows it and goes on\n> over two lines!\nOnly a sentence."),
        (1, 5, "user", ">> and goes on over two lines! A third, short one.\n> Wrapped anew.\nA line, and a reply to a reply."),
        (None, 1, "user", "> lost"), (2, None, "user", "no turn"),
    ]
    got = {(r.conv_id, r.turn): r for r in quote_threads.threads(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [got[1, t].parent_turn for t in range(1, 6)] == [None, 1, 1, 1, 3]
    assert got[1, 5].quoted_turns == [3, 1] and got[1, 3].text == "Wrapped anew."
    assert len(got) == 7 and got[None, 1].thread is None and got[None, 1].text == "" and got[2, None].reply_rank is None


def test_nested_quotes_and_unknown_places(spark):
    rows = [(1, 0, "user", "First line here.\nSecond"), (1, 1, "assistant", "> First LINE here\nanswer"), (1, 2, "user", ">> first line here\n> answer\nthanks"), (1, 5, "user", "> not said before\nok"), (None, 1, "user", "x"), (2, None, "user", None)]
    got = {(r.conv_id, r.turn): r for r in quote_threads.threads(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1, 1].parent_turn == 0 and got[1, 1].text == "answer"
    assert got[1, 2].parent_turn == 1 and got[1, 2].quoted_turns == [1, 0] and got[1, 2].text == "thanks"
    assert got[1, 5].parent_turn == 2 and got[1, 5].text == "ok"
    assert got[None, 1].reply_rank is None and got[2, None].text == ""
    assert quote_threads.threads(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# ---------------------------------------------------------------- op2


def brute_classes(texts, threshold=0.8):
    import pyarrow as pa

    sets = []
    for _, s, _, _ in bagminhash.multiset(pa.array(texts, pa.string()), 5):
        sets += s
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            same = (texts[i] or "") == (texts[j] or "")
            if same or bagminhash.overlap(sets[i], sets[j]) >= threshold:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("bucket_pairs", [8, 1])
def test_classes_like_brute_force(spark, bucket_pairs):
    r = random.Random(3)
    base = [f"word{r.randint(0, 400)}" for _ in range(80)]
    texts = list(ODD)
    for _ in range(60):  # near copies with 0 to 4 edits: links, non-links and chains
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = f"edit{r.randint(0, 9999)}"
        texts.append(" ".join(w))
    texts += [" ".join(base[:60] + [f"u{k}-{i}" for i in range(40)]) for k in range(12)]  # share a passage only
    texts += ["x y " * 200, "x y " * 180, "x y " * 100]  # multiset weights
    got = bagminhash.near_duplicates(docs(spark, texts), bucket_pairs=bucket_pairs).collect()
    assert {r.doc_id: r.class_id for r in got} == dict(enumerate(brute_classes(texts)))


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(0)
    m, a = 4000, rng.integers(1, 2**62, 40).astype(np.uint64)
    ca, cb = rng.integers(0, 9, 40), rng.integers(0, 9, 40)
    want = np.minimum(ca, cb).sum() / np.maximum(ca, cb).sum()
    ia, ib = np.flatnonzero(ca), np.flatnonzero(cb)
    sig = bagminhash.signatures(np.concatenate([a[ia], a[ib]]), np.concatenate([ca[ia], cb[ib]]), np.repeat([0, 1], [len(ia), len(ib)]), 2, m)
    assert np.isfinite(sig).all() and abs((sig[0] == sig[1]).mean() - want) < 4 * (want * (1 - want) / m) ** 0.5


def test_repeated_ids_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "q r s t u v"), (None, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.class_id or 0) for r in bagminhash.near_duplicates(df).collect())
    assert got == [(0, 0), (1, 1), (1, 1), (2, 1)]
    # the two different texts of document 1 are two classes, so both stay
    assert sorted((r.doc_id or 0, r.text) for r in bagminhash.keep_first(df).collect()) == [(0, "a b c d e f"), (1, "a b c d e f"), (1, "q r s t u v")]


def test_rows_of_one_id_are_told_apart_in_any_order(spark):
    a = " ".join(f"a{i}" for i in range(40))
    b = " ".join(f"b{i}" for i in range(60))
    near = b.replace("b30", "other")
    rows = [(1, a, "x"), (1, b, "y"), (2, near, "z"), (1, b, "y"), (3, a + " ", "w"), (4, "alone", None)]
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "doc_id long, text string, other string")
        got = {(t, r.class_id) for r in bagminhash.near_duplicates(df).collect() for t in [r.doc_id]}
        assert got == {(1, 1), (2, 1), (3, 1), (4, 4)}
        assert sorted(map(tuple, bagminhash.keep_first(df).collect()), key=repr) == [(1, a, "x"), (1, b, "y"), (4, "alone", None)]


# ---------------------------------------------------------------- op3


def test_tokens_like_the_library(spark, tmp_path):
    texts = [*ODD, "don't we're X—. é.́, 12ab 3.5e7 İstanbul ΑΣ. ﬁ …  <|endoftext|> z <|nope|>", "O'Neill's 'tis ''s x　y a\x1cb a≠b ≠"]
    df = docs(spark, texts)
    path, tok = str(tmp_path / "t"), token_store.tokenizer(queries.tokenizer_file())
    token_store.write_tokens(df, path, queries.tokenizer_file(), row_group_bytes=1 << 16, page_bytes=1 << 10)
    got = {r.doc_id: r for r in token_store.token_digests(token_store.read_tokens(spark, path)).collect()}
    start = 0
    for i, t in enumerate(texts):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    import pyarrow.parquet as pq

    files = sorted(tmp_path.glob("t/*.parquet"))
    column = pq.ParquetFile(files[-1]).metadata.row_group(0)
    by_name = {column.column(i).path_in_schema: column.column(i) for i in range(column.num_columns)}
    assert by_name["doc_id"].has_column_index and by_name["ids.list.element"].has_offset_index


def test_small_piece_table_gives_the_same_ids():
    import pyarrow as pa

    coder = token_store.PieceEncoder(queries.tokenizer_file(), slots=64, pool=512)
    texts = [" ".join(f"tok{i}{j}" for j in range(50)) for i in range(20)]
    for row, data, offs in text_slices(pa.array(texts), limit=600):
        ids, bounds = coder.encode(data, offs)
        for i in range(len(offs) - 1):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == coder.tok.encode(texts[row + i], add_special_tokens=False).ids


# ---------------------------------------------------------------- op4


def test_license_rules(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n"
    rest = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
    texts = [mit + rest, rest + "\n\n" + mit, "x\nLicensed under CC BY-NC 4.0.\nAll rights reserved.", None, "nothing", "the MIT License is mentioned", "Released under the MIT License. Released under the MIT License."]
    got = {r.doc_id: (r.licences, r.matched_rules) for r in license_rules.scan(docs(spark, texts)).collect()}
    assert got[0] == ("MIT", "mit-text") and got[1] == ("", "")  # the order counts
    assert got[2] == ("CC-BY-NC-4.0,proprietary-notice", "all-rights-reserved,cc-by-nc-4.0-licensed")
    assert got[3] == got[4] == got[5] == ("", "") and got[6][0] == "MIT"


APACHE = """Copyright 2020 A. Name

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
GPL = """Copyright (C) 2020 A. Name

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
BSD = """Copyright (c) 2020, A. Name
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice,
   this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

{}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE."""
NAMES = """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

"""
MIT = """Copyright (c) 2020 A. Name

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
NOTICES = {
    "Apache-2.0": APACHE,
    "GPL-3.0-or-later": GPL,
    "BSD-2-Clause": BSD.format(""),
    "BSD-3-Clause": BSD.format(NAMES),
    "MIT": MIT,
}


def test_standard_notices_plain_and_commented(spark, duck):
    """Every notice of several sentences, as it is published and in the comments of common languages."""
    texts, want = [], []
    for licence, text in (NOTICES | {"Apache-2.0 ": APACHE.replace("http:", "https:"), "GPL-3.0-or-later ": GPL.replace("software:", "software;"), "BSD-2-Clause ": BSD.format("").replace("HOLDERS AND", "HOLDER AND")}).items():
        lines = text.split("\n")
        for start, mark, end in (("", "", ""), ("", "# ", ""), ("", "// ", ""), ("/*\n", " * ", "\n */"), ("<!--\n", "  ~ ", "\n-->"), ("", "-- ", ""), ("", "% ", "")):
            for glue in ("\n", "\r\n"):
                texts.append(start + glue.join((mark + x).rstrip() for x in lines) + end + "\n\nimport os\n")
                want.append(licence.strip())
        texts.append(text.replace("\n\n", "\n\n\n"))
        want.append(licence.strip())
    df = docs(spark, texts)
    got = license_rules.scan(df).collect()
    found = {r.doc_id: set(r.licences.split(",")) - {"proprietary-notice"} for r in got}
    assert [found[i] for i in range(len(texts))] == [{x} for x in want]
    duck.register("notices", df.toPandas())
    same_rows(license_rules.scan(df), duck.sql(license_rules.oracle().replace("FROM documents", "FROM notices")))


def test_every_notice_is_found_plain_wrapped_and_commented(spark):
    import textwrap

    texts, want = [], []
    for licence, text in license_rules.NOTICES.items():
        lines = textwrap.wrap(text, 60)
        texts += [f"Copyright 2020\n\n{text}\n\nmore", "\n".join(lines), "\n".join(f"# {x}" for x in lines), "/*\n" + "\n".join(f" * {x}" for x in lines) + "\n */", "\n".join(f"// {x}" for x in lines)]
        want += [licence] * 5
    got = {r.doc_id: r.licences for r in license_rules.scan(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert all(license_rules.cut(text) for text in license_rules.NOTICES.values())


def test_known_sentences_have_no_cut_inside(spark):
    for name, sentence in license_rules.SENTENCES.items():
        assert sentence == " ".join(sentence.split()) and not set(sentence) & set(".!?:;\n"), name
    assert {i for _, _, r in license_rules.RULES for i in r} <= set(license_rules.SENTENCES)
    assert len({n for n, _, _ in license_rules.RULES}) == len(license_rules.RULES)


# ---------------------------------------------------------------- op5


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_lines_like_brute_force(spark):
    r = random.Random(11)
    pool = ["the quick brown fox jumps", "entirely other words stand here", "aaaaaaaaaaaaaaaaaaaa", "prix élevé de la forêt près d'ici", "short"]
    texts = [None, "", "short\nshort"]
    for _ in range(40):
        lines = []
        for _ in range(r.randint(1, 6)):
            s = list(r.choice(pool))
            for _ in range(r.choice([0, 0, 1, 1, 2])):
                k, op = r.randrange(len(s)), r.randrange(3)
                s[k : k + (op != 0)] = [] if op == 1 else [r.choice("xéz ")]
            lines.append("".join(s))
        texts.append("\n".join(lines))
    got = {x.doc_id: x.text for x in line_dedup.dedup_lines(docs(spark, texts)).collect()}
    norm = lambda s: " ".join(s.lower().split(" ")).strip() if "  " not in s else " ".join(x for x in s.lower().split(" ") if x)
    seen = []
    for i, t in enumerate(texts):
        keep = []
        for line in (t or "").split("\n"):
            n = norm(line)
            close = n in seen or len(n) >= line_dedup.MIN_CHARS and any(len(o) >= line_dedup.MIN_CHARS and abs(len(n) - len(o)) <= 1 and levenshtein(n, o) <= 1 for o in seen)
            if not n or not close:
                keep.append(line)
            if n:
                seen.append(n)
        assert got[i] == "\n".join(keep), i


def test_lines_of_rows_with_one_id(spark):
    lines, other = "this is line one of it\nshort", "another line of some length"
    rows = [(1, lines), (2, lines), (2, other), (2, lines), (None, "short"), (None, "short"), (1, other)]
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        got = sorted((r.doc_id or 0, r.n_lines, r.text) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
        assert got == sorted([(0, 1, "short"), (0, 1, ""), (1, 2, "this is line one of it"), (1, 1, other), (2, 2, ""), (2, 2, ""), (2, 1, "")])


# ---------------------------------------------------------------- op6


def test_schedule_deviates_by_less_than_one_block():
    for seed in range(60):
        r = random.Random(seed)
        w = {f"s{i}": r.randint(1, 40) for i in range(r.randint(1, 9))}
        total, owner = sum(w.values()), {}
        for k, v in pfair.period(w).items():
            owner |= dict.fromkeys(v, k)
        assert sorted(owner) == list(range(total))
        count = dict.fromkeys(w, 0)
        for t in range(total):
            count[owner[t]] += 1
            assert all(abs(count[k] - w[k] * (t + 1) / total) < 1 for k in w)
        blocks = {k: r.randint(0, 90) for k in w}
        slots = [p["start"] + j // len(p["places"]) * p["total"] + p["places"][j % len(p["places"])] for p in pfair.plan(blocks, w) for j in range(p["used"])]
        assert sorted(slots) == list(range(sum(blocks.values())))


@pytest.mark.parametrize("kind", ["two", "hot", "many"])
def test_schedule_keeps_to_the_unrounded_targets(kind):
    if kind == "two":
        share, blocks = {"a": 0.999, "b": 0.001}, {"a": 100_000, "b": 200}
    else:
        rows = {"hot": 500_000} | {f"s{i:04}": 1000 for i in range(999)} if kind == "hot" else {f"s{i:04}": 17 + i * i % 3001 for i in range(1500)}
        share, blocks = {k: v**0.5 for k, v in rows.items()}, {k: -(-v // pfair.BLOCK_ROWS) for k, v in rows.items()}
    names = list(share)
    owner = {}
    for p in pfair.plan(blocks, pfair.whole_weights(share, blocks)):
        assert len(p["places"]) <= p["total"]
        for j in range(p["used"]):
            owner[p["start"] + j // len(p["places"]) * p["total"] + p["places"][j % len(p["places"])]] = names.index(p["key"])
    assert sorted(owner) == list(range(sum(blocks.values())))
    # until the first source runs out
    t, left, count = np.array([share[k] for k in names]) / sum(share.values()), np.array([blocks[k] for k in names]), np.zeros(len(names))
    for slot in range(len(owner)):
        count[owner[slot]] += 1
        if slot % 7 == 0:
            assert np.abs(count - t * (slot + 1)).max() < 2, slot
        if count[owner[slot]] == left[owner[slot]]:
            break
    assert slot > 1000


def test_small_tables_keep_the_least_resolution():
    rows = {"a": 5000, "b": 3000, "c": 1500, "d": 500}
    share, blocks = {k: v**0.5 for k, v in rows.items()}, {k: -(-v // pfair.BLOCK_ROWS) for k, v in rows.items()}
    assert pfair.whole_weights(share, {k: 5 for k in blocks}) == pfair.target_weights(rows)


def test_interleave_like_brute_force(spark):
    r = random.Random(2)
    sources = [r.choice(["hot", "hot", "hot", "b", None, ""]) for _ in range(300)]
    df = docs(spark, [f"t{i}" for i in range(300)], sources)
    got = pfair.interleave(df, block_rows=4, piece_rows=10).collect()
    key = lambda s: "null" if s is None else f"={s}"
    groups: dict = {}
    for i, s in enumerate(sources):
        groups.setdefault(key(s), []).append((hashlib.md5(str(i).encode()).hexdigest(), i))
    slot = {}
    n = {k: len(v) for k, v in groups.items()}
    for p in pfair.plan({k: -(-v // 4) for k, v in n.items()}, pfair.target_weights(n)):
        for j in range(p["used"]):
            slot[p["key"], p["first"] + j] = p["start"] + j // len(p["places"]) * p["total"] + p["places"][j % len(p["places"])]
    want = {}
    for k, v in groups.items():
        for pos, (_, i) in enumerate(sorted(v)):
            want[i] = slot[k, pos // 4] * 4 + pos % 4
    assert {r.doc_id: r.mix_position for r in got} == want and len(set(want.values())) == 300
    given = pfair.interleave(df, weights={"b": 3, "hot": 1}, block_rows=4).collect()
    assert len(given) == 300 and pfair.interleave(df.limit(0)).count() == 0


# ---------------------------------------------------------------- op8


def test_phrases_like_brute_force(spark):
    r = random.Random(4)
    vocabulary = [f"v{i}" for i in range(12)]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, say(r.choice([0, 1, 3, 10, 14]))) for i in range(12)] + [(3, None)]
    texts = list(ODD)
    for _ in range(30):
        extra = r.choice(items)[1] or ""
        texts = [*texts, f"{say(r.randint(0, 200))} {extra} {say(5)}"]
    got = {x.doc_id: x for x in phrase_index.match_digests(phrase_index.decontaminate(docs(spark, texts), spark.createDataFrame(items, "item_id long, text string"))).collect()}
    for i, t in enumerate(texts):
        w, hit, found = words(t), set(), set()
        for item, it in items:
            q = words(it)
            for k in range(max(1, len(q) - 9) if q else 0):
                window = q[k : k + 10]
                for a in range(len(w) - len(window) + 1):
                    if w[a : a + len(window)] == window:
                        hit |= set(range(a, a + len(window)))
                        found.add(str(item))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].items_sha256, got[i].contaminated) == (len(w), len(hit), len(found), digest, bool(hit)), i


def test_phrases_in_passes_and_without_ids(spark):
    r = random.Random(5)
    say = lambda n: " ".join(f"v{r.randrange(9)}" for _ in range(n))
    items = [(i % 7 if i % 4 else None, say(r.choice([0, 1, 3, 10, 14, 30]))) for i in range(20)] + [(None, "only without an id"), (3, None)]
    texts = [*ODD, "a text with only without an id in it", *[f"{say(r.randint(0, 40))} {r.choice(items)[1]} {say(5)}" for _ in range(40)]]
    df, bench = docs(spark, texts).withColumn("doc_id", F.when(F.col("doc_id") > 20, F.col("doc_id")).when(F.col("doc_id") > 8, 5)), spark.createDataFrame(items, "item_id long, text string")
    plain = lambda rows: sorted((tuple(x) for x in rows.collect()), key=repr)
    once = plain(phrase_index.decontaminate(df, bench))
    assert len(once) == len(texts) and once == plain(phrase_index.decontaminate(df, bench, pass_phrases=50))
    assert once == plain(phrase_index.find(phrase_index.build_index(df), bench))  # an index that is there serves any items
    phrase_index.EXPANDED, whole = 64, phrase_index.EXPANDED
    ph = phrase_index.phrases_of(phrase_index.phrase_table(bench))
    b = [x for _, _, x in phrase_index._blocks(phrase_index.build_index(df).toArrow().to_batches(), ph)]
    some = [sorted(zip(*map(np.ndarray.tolist, x.exact(ph)), strict=True)) for x in b]
    phrase_index.EXPANDED = whole
    assert some == [sorted(zip(*map(np.ndarray.tolist, x.exact(ph)), strict=True)) for x in b]  # expanded a few at a time
    assert any(x[1:5] == (9, 4, 1, []) for x in once)  # hits without an item's id


def test_proximity(spark):
    d = docs(spark, ["one two three four", "four x one y two three", "one two"])
    ph = phrase_index.phrases_of(phrase_index.phrase_table(spark.createDataFrame([(7, "two three four one")], "item_id long, text string")))
    index = phrase_index.build_index(d)
    assert {r.doc_id for r in phrase_index.proximity(index, ph, 3).collect()} == {0, 1}
    assert [(r.doc_id, r.position, r["items"]) for r in phrase_index.proximity(index, ph, 0).collect()] == [(0, 0, ["7"])]
    assert phrase_index.search(index, ph).where("n_hit > 0").count() == 0


def test_rows_are_judged_by_their_own_text(spark):
    rows = [(1, "a b c d"), (1, "clean"), (None, "x a b c d"), (None, "y"), (2, "b c")]
    kept = phrase_index.keep_clean(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(None, "a b c d")], "item_id long, text string"))
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([(1, "clean"), (None, "y"), (2, "b c")], key=repr)


# ---------------------------------------------------------------- op9, op10


@pytest.mark.parametrize(("head", "middle", "rare"), [(0, 200, 0), (60, 100, 0), (200, 0, 0), (20, 200, 60)])
def test_block_max_search_is_exact(monkeypatch, head, middle, rare):
    monkeypatch.setattr(toxicity, "RARE", rare)
    rng = np.random.default_rng(0)
    n, v = 1500, 200
    code = np.unique(np.repeat(np.arange(n), 8) * v + rng.integers(0, v, n * 8))
    row, term, value = code // v, code % v, rng.random(len(code))
    value /= np.sqrt(np.bincount(row, weights=value**2))[row]
    index, dense = toxicity.BlockMaxIndex(row, term, value, n, v, head_bytes=4 * (n + 31) * head, middle_bytes=4 * 47 * middle), np.zeros((n, v))
    dense[row, term] = value
    asked = []
    for _ in range(100):
        q = np.unique(rng.integers(0, v, 6))
        x = rng.random(len(q))
        asked.append((q, x / np.sqrt(x @ x)))
    for (q, x), (at, score) in zip(asked, index.nearest(asked, 15), strict=True):
        full = dense[:, q] @ x
        assert np.allclose(np.sort(score)[::-1][:15], np.sort(full)[::-1][:15], atol=1e-5)
        assert set(at.tolist()) >= set(np.flatnonzero(full > np.sort(full)[-15] + 1e-4).tolist())


def _held_out(spark, name, label):
    got = queries.QUERIES[name](spark, "/root/testdata/sf0.1")
    rows = got.where("held_out").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").toPandas()
    assert got.where("score < 0 or score > 1 or score is null").count() == 0
    return rows[label].to_numpy(), rows["predicted"].to_numpy(), rows["score"].to_numpy()


def test_toxicity_on_held_out_rows(spark):
    y, p, s = _held_out(spark, "op9_toxicity", "toxic")
    assert (y == p).mean() > 0.98 and p[y == 1].mean() >= 0.9 and p[y == 0].mean() < 0.01 and ((s - y) ** 2).mean() < 0.03


def test_quality_on_held_out_rows(spark):
    y, p, s = _held_out(spark, "op10_quality", "quality")
    assert (y == p).mean() > 0.98 and p[y == 1].mean() > 0.99 and p[y == 0].mean() < 0.06 and ((s - y) ** 2).mean() < 0.02


def test_scores_do_not_read_labels_of_the_held_out_fold(spark):
    d = spark.read.parquet(f"{DIR}/documents.parquet")
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(quality.held_out(4, 2), 1 - F.col("quality")).otherwise(F.col("quality")))
    a = {r.doc_id: r.score for r in quality.score(d, quality.fit(d, labels)).collect()}
    assert a == {r.doc_id: r.score for r in quality.score(d, quality.fit(d, flipped)).collect()}


# ---------------------------------------------------------------- op7


def test_media_round_trip(spark):
    got = {r.doc_id: r for r in queries.op7_webp(spark, DIR).collect()}
    for r in spark.read.parquet(f"{DIR}/documents.parquet").collect():
        raw = (r.text or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        x = got[r.doc_id]
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    rng = np.random.default_rng(0)
    for n, kinds in ((1, 256), (1, 2), (4, 4), (5, 3), (40, 256), (300, 5)):
        payload = rng.integers(0, kinds, webp.PAD * n, dtype=np.uint8)
        for style in range(4):
            assert np.array_equal(webp.decode(webp.encode(payload, style)).reshape(-1), payload)


def test_stored_payloads_use_the_whole_format(spark, monkeypatch):
    """Palette, back-references, cache and codes of several lengths occur in stored texts; predictor and cross-colour in payloads for which they pay."""
    used = set()

    def watch(name, feature, when=lambda *a: True):
        inner = getattr(webp, name)
        monkeypatch.setattr(webp, name, lambda *a: (used.add(feature) if when(*a) else None, inner(*a))[1])

    watch("_unpredict", "predictor", lambda img, modes, bits: len(set(modes.ravel().tolist())) > 1)
    watch("_uncross", "cross-colour", lambda img, data, bits: data[..., 1:].any())
    watch("_unindex", "palette")
    watch("_number", "back-reference")
    watch("_one_group", "cache", lambda bits, codes, *a: (codes[0].symbols >= 280).any())
    watch("_one_group", "lengths", lambda bits, codes, *a: len(set(codes[0].lengths[codes[0].symbols].tolist())) > 3)
    stored = 0
    for r in spark.read.parquet(f"{DIR}/documents.parquet").collect():
        raw = (r.text or "").encode()
        payload = np.frombuffer(raw + b"\xff" * (webp.padded(len(raw)) - len(raw)), np.uint8)
        files = webp.encode_payload(payload)
        stored += sum(map(len, files))
        assert webp.decode_payload([webp.decode(x) for x in files], len(raw)).tobytes() == payload.tobytes()
    assert {"palette", "back-reference", "cache", "lengths"} <= used and stored > 0
    rng = np.random.default_rng(0)
    y, x = np.mgrid[0:72, 0 : webp.WIDTH]
    smooth = np.stack([x * y // 40 + rng.integers(0, 3, x.shape), x + y, 255 - x + y // 2, x // 2 + 3 * y], axis=2)
    noise = rng.integers(0, 256, (72, webp.WIDTH))
    linked = np.stack([np.full_like(noise, 255), noise + rng.integers(0, 2, noise.shape), noise, noise + 5], axis=2)
    for img in (smooth, linked):
        payload = (img & 255).astype(np.uint8).reshape(-1)
        assert webp.decode_payload([webp.decode(f) for f in webp.encode_payload(payload)], len(payload)).tobytes() == payload.tobytes()
    assert used == {"predictor", "cross-colour", "palette", "back-reference", "cache", "lengths"}


def test_long_payloads_get_wide_images_and_several_files(monkeypatch):
    monkeypatch.setattr(webp, "MAX_SIDE", 300)
    monkeypatch.setattr(webp, "MOST_BYTES", 4 * (300 // webp.WIDTH) * webp.WIDTH * 300)
    payload = np.random.default_rng(1).integers(0, 7, webp.PAD * 1000, dtype=np.uint8)
    files = webp.encode_payload(payload)
    images = [webp.decode(x) for x in files]
    assert len(files) > 1 and all(max(x.shape[:2]) <= 300 for x in images)
    assert np.array_equal(webp.decode_payload(images, len(payload)), payload)


def test_decode_images_of_one_file_a_row(spark):
    media = webp.encode(np.arange(webp.PAD * 2, dtype=np.int64).astype(np.uint8))
    rows = webp.decode_images(spark.createDataFrame([(1, bytearray(media)), (2, None)], "id long, m binary"), "m", ("id",)).orderBy("id").collect()
    image = rows[0].images[0]
    assert (image.height, image.width) == (2, webp.WIDTH) and bytes(image.pixels) == np.arange(webp.PAD * 2, dtype=np.int64).astype(np.uint8).tobytes()
    assert rows[1].images == []
