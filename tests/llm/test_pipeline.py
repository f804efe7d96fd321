"""The pipeline's stages and its whole result against plain Python on the smallest tables and on odd ones."""

import hashlib
import zlib

import numpy as np
from test_small_ops import ODD, brute_classes, docs, words

import corpus_pipeline
from atlasforge.llm import pfair, quality, queries, token_store

DIR = "/root/testdata/sf0.001"


def hit(text, windows):
    w = words(text)
    return any(tuple(w[i : i + n]) in windows[n] for n in windows for i in range(len(w) - n + 1))


def expected(spark, rows, sf_dir):
    """doc_id order and token digests of the final files for the rows that the quality stage keeps."""
    texts = [r.text for r in rows]
    rows = [r for i, r in enumerate(rows) if brute_classes(texts)[i] == i] if len(rows) < 60 else [rows[i] for i in sorted(set(brute_classes(texts)))]
    windows: dict = {}
    for b in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        w = words(b.text or "")
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows.setdefault(n, set()).add(tuple(w[k : k + n]))
    rows = [r for r in rows if not hit(r.text or "", windows)]
    groups: dict = {}
    for r in rows:
        groups.setdefault("null" if r.source is None else f"={r.source}", []).append((hashlib.md5(str(r.doc_id).encode()).hexdigest(), r))
    count = {k: len(v) for k, v in groups.items()}
    slot = {}
    for p in pfair.plan({k: -(-v // pfair.BLOCK_ROWS) for k, v in count.items()}, pfair.target_weights(count)):
        for j in range(p["used"]):
            slot[p["key"], p["first"] + j] = p["start"] + j // len(p["places"]) * p["total"] + p["places"][j % len(p["places"])]
    placed = [(slot[k, i // pfair.BLOCK_ROWS], i % pfair.BLOCK_ROWS, r) for k, v in groups.items() for i, (_, r) in enumerate(sorted(v, key=lambda x: x[0]))]
    tok, start, out = token_store.tokenizer(queries.tokenizer_file()), 0, {}
    for _, _, r in sorted(placed, key=lambda x: x[:2]):
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 2]
        out[r.doc_id] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    return out


def test_whole_pipeline(spark):
    table = spark.read.parquet(f"{DIR}/documents.parquet")
    kept = corpus_pipeline.STAGES[0][1](spark, table, DIR)
    assert kept.columns == table.columns
    scores = quality.score(table, quality.fit(table, spark.read.parquet(f"{DIR}/labels.parquet")))
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in scores.where("predicted = 1").collect()}
    want = expected(spark, sorted(kept.collect(), key=lambda r: r.doc_id), DIR)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in corpus_pipeline.run(spark, DIR).collect()}
    assert got == want and 0 < len(got) < table.count()


def test_stages_keep_the_columns_and_clean_rows(spark, tmp_path):
    d = tmp_path / "odd"
    spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string").write.parquet(str(d / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(d / "labels.parquet"))
    table = docs(spark, ODD)
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, str(d))
        assert out.columns == table.columns and stage(spark, table.limit(0), str(d)).count() == 0
        kept[name] = sorted(r.doc_id for r in out.collect())
    assert kept["quality"] == kept["mix"] == list(range(11))  # no labels: nothing is rejected
    assert kept["near_dedup"] == [0, 2, 3, 4, 5, 7, 8, 9] and kept["decontamination"] == [0, 1, 2, 3, 4, 7, 8, 9, 10]


def test_repeated_and_missing_ids_through_all_stages(spark, tmp_path):
    """Rows that share an id, or have none, odd texts, and columns with clashing names: each kept row is encoded once, in one order."""
    d = tmp_path / "ids"
    extra = [("one more text with words of its own", 3), ("another one of the same number", 3), ("a row without a number", None), ("a second row without a number", None), ("one", None), ("rows that are wholly equal stay once", 20), ("rows that are wholly equal stay once", 20)]
    rows = [(i, t, "en", "s", 1, "x", "y", "z", 0.5) for i, t in enumerate(ODD)] + [(i, t, "en", None, 1, "x", "y", "z", 0.5) for t, i in extra]
    schema = "doc_id long, text string, lang string, source string, n_chars long, ids string, key string, digest string, mix_position double"
    spark.createDataFrame(rows, schema).write.parquet(str(d / "documents.parquet"))
    spark.createDataFrame([(1, "a second row without"), (2, None)], "item_id long, text string").write.parquet(str(d / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(d / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(d)).collect()
    # of equal texts the least id stays, but rows without an id stay; the benchmark's passage takes one of them
    kept = [(0, ""), (2, " \n "), (3, "one"), (4, ODD[4]), (5, ODD[5]), (7, ODD[7]), (8, ODD[8]), (9, "..."), (3, extra[0][0]), (3, extra[1][0]), (None, extra[2][0]), (None, "one"), (20, extra[5][0])]
    tok = token_store.tokenizer(queries.tokenizer_file())
    ids = [(i, [*tok.encode(t, add_special_tokens=False).ids, 2]) for i, t in kept]
    want = sorted(((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids), key=repr)
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=repr) == want
    start = 0
    for r in sorted(got, key=lambda r: (r.start, r.n_tokens)):
        assert r.start == start
        start += r.n_tokens
    none = tmp_path / "none"
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(str(d / f"{name}.parquet")).limit(0).write.parquet(str(none / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(none)).count() == 0
