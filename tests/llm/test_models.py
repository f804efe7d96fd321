"""Toxicity and quality as whole queries against plain Python, and hashes that must not confuse words."""

import tracemalloc
import zlib
from collections import Counter

import numpy as np
from test_small_ops import DIR, LONG, docs, words

from atlasforge.llm import bagminhash, calibrate, phrase_index, quality, queries, token_store, toxicity


def tables(spark, label):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{DIR}/labels.parquet").collect() if r[label] is not None and r.doc_id in texts}
    return texts, labels


def toxic_terms(text):
    out = []
    for w in words(text):
        raw = w.encode()
        out += [raw, *((k, raw[:k]) for k in toxicity.BEGINNINGS if len(raw) > k)]
    return Counter(out)


def toxic_relevance(train, counts, y):
    n1, n = sum(y[i] for i in train), len(train)
    rate, out = {}, {}
    for c, m in ((1, n1), (0, n - n1)):
        have = Counter(t for i in train if y[i] == c for t in counts[i])
        rate[c] = (have, m, max(m / n, 1e-6))
    for t in {t for i in y for t in counts[i]}:
        r = [np.log((h[t] + toxicity.SMOOTHING * p) / (m + toxicity.SMOOTHING)) for h, m, p in (rate[1], rate[0])]
        out[t] = toxicity.FLOOR + (r[0] - r[1]) ** 2
    return out


def toxic_vote(text_counts, train, vectors, weight, y, row_weight):
    q = {t: (1 + np.log(c)) * weight[t] for t, c in text_counts.items() if t in weight}
    length = max(np.sqrt(sum(v * v for v in q.values())), 1e-300)
    cosine = {i: sum(v / length * vectors[i].get(t, 0.0) for t, v in q.items()) for i in train}
    kth = sorted(cosine.values())[-min(toxicity.NEIGHBOURS, len(train))]
    near = [i for i in train if cosine[i] >= kth - toxicity.TIE]
    w = {i: max(cosine[i], 1e-6) ** 2 * row_weight[y[i]] for i in near}
    return sum(w[i] * y[i] for i in near) / sum(w.values())


def unit_vectors(train, counts, weight):
    out = {}
    for i in train:
        v = {t: (1 + np.log(c)) * weight[t] for t, c in counts[i].items()}
        length = max(np.sqrt(sum(x * x for x in v.values())), 1e-300)
        out[i] = {t: x / length for t, x in v.items()}
    return out


def test_toxicity_like_brute_force(spark):
    texts, labels = tables(spark, "toxic")
    counts = {i: toxic_terms(t) for i, t in texts.items()}
    train = sorted(i for i in labels if zlib.crc32(str(i).encode()) % 5)
    y = {i: labels[i] for i in train}
    df = Counter(t for c in counts.values() for t in c)
    idf = {t: np.log((1 + len(texts)) / (1 + df[t])) + 1 for i in train for t in counts[i]}
    weights = [{t: idf[t] * r for t, r in toxic_relevance([i for k, i in enumerate(train) if k % toxicity.FOLDS != f], counts, y).items()} for f in range(toxicity.FOLDS)]
    votes = []
    for k, i in enumerate(train):
        others = [j for n, j in enumerate(train) if n % toxicity.FOLDS != k % toxicity.FOLDS]
        w = weights[k % toxicity.FOLDS]
        votes.append(toxic_vote(counts[i], others, unit_vectors(others, counts, w), w, y, {0: 1.0, 1: 1.0}))
    ys = np.array([y[i] for i in train])
    curve = calibrate.Isotonic(np.array(votes), ys, np.ones(len(ys)))
    w = {t: idf[t] * r for t, r in toxic_relevance(train, counts, y).items()}
    vectors = unit_vectors(train, counts, w)
    got = {r.doc_id: r for r in queries.op9_toxicity(spark, DIR).collect()}
    assert len(got) == len(texts)
    for i in texts:
        want = float(curve(np.array([toxic_vote(counts[i], train, vectors, w, y, {0: 1.0, 1: 1.0})]))[0])
        assert abs(got[i].score - want) < 1e-3, (i, got[i].score, want)
        assert got[i].predicted == int(got[i].score >= 0.5) and got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)


def test_quality_axes_fit_the_driver():
    """The driver holds the terms by axes once and the axes beside it, never in double precision; the axes are those of the whole product."""
    n, n_terms, each = 300, 100_000, 1000
    rng = np.random.default_rng(3)
    number = np.sort(np.array([rng.choice(n_terms, each, replace=False) for _ in range(n)]), axis=1).ravel().astype(np.int32)
    terms = np.sort(rng.integers(0, 1 << 63, n_terms).astype(np.uint64))
    bounds = np.arange(0, n * each + 1, each)
    sample = calibrate.Sample(np.arange(n), np.arange(n) % 2, np.ones(n), terms, bounds, number, rng.integers(1, 4, n * each).astype(np.int32))
    df = np.bincount(number, minlength=n_terms)
    tracemalloc.start()
    model = quality.Model(sample, df, n)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    side = n_terms * (quality.DIMS + quality.SPARE) * 4
    assert peak < 4 * side, f"{peak / side:.1f} times the terms by axes"
    assert np.allclose(model.axes.T @ model.axes, np.eye(quality.DIMS), atol=1e-3)
    value = quality.weighted(n, sample.owner, number, sample.count, np.zeros(n), model.idf, model.style, model.rare)
    dense = np.zeros((n, n_terms), dtype=np.float32)
    dense[sample.owner, number] = value
    assert np.allclose(quality.unit(dense @ model.axes), model.bank, atol=1e-4)


def test_quality_votes_like_brute_force(spark):
    table = spark.read.parquet(f"{DIR}/documents.parquet")
    model = quality.fit(table, spark.read.parquet(f"{DIR}/labels.parquet"))
    _, labels = tables(spark, "quality")
    train = sorted(i for i in labels if zlib.crc32(str(i).encode()) % 4 != 2)
    rows = table.select("doc_id", "text").orderBy("doc_id").toArrow()
    ids, bank = rows.column("doc_id").to_pylist(), []
    for _, x in model.vectors(rows.column("text").combine_chunks()):
        bank.append(x.astype(float))
    x = np.concatenate(bank)
    labelled = x[[ids.index(i) for i in train]]  # labelled texts come out as they went in: they have no unknown term
    assert np.allclose(labelled, model.bank, atol=1e-4)
    y = np.array([labels[i] for i in train])
    got = {r.doc_id: r for r in queries.op10_quality(spark, DIR).collect()}

    def vote(v, skip=None):
        cosine = labelled @ v
        if skip is not None:
            cosine[skip] = -2
        kth = np.sort(cosine)[-min(model.k, len(y) - (skip is not None))]
        near = [j for j in range(len(y)) if cosine[j] >= kth - quality.TIE]
        w = np.array([max(cosine[j], 1e-3) ** 4 for j in near])
        return float((w * y[near]).sum() / w.sum())

    curve = calibrate.Isotonic(np.array([vote(labelled[j], j) for j in range(len(y))]), y, np.ones(len(y)))
    for i, v in zip(ids, x, strict=True):
        assert abs(got[i].score - float(curve(np.array([vote(v)]))[0])) < 2e-3, i


def test_latent_axes_are_those_of_the_whole_decomposition(spark):
    """The subspace holds as much of the labelled matrix as the exact SVD's."""
    table, labels = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")
    sample = calibrate.labelled_sample(table, labels, "quality", ~calibrate.held_out(4, 2), quality.terms_of)
    df, n_docs = quality.document_frequencies(table, sample.terms, quality.terms_of)
    model = quality.Model(sample, df, n_docs, dims=8)
    dense = np.zeros((len(sample.y), len(sample.terms)))
    dense[sample.owner, sample.number] = quality.weighted(len(sample.y), sample.owner, sample.number, sample.count, np.zeros(len(sample.y)), model.idf, model.style, model.rare)
    exact = (np.linalg.svd(dense, compute_uv=False)[:8] ** 2).sum()
    assert np.allclose(model.axes.T @ model.axes, np.eye(8), atol=1e-3)
    assert ((dense @ model.axes) ** 2).sum() > 0.98 * exact


def test_sample_is_bounded_in_bytes(spark):
    table, labels = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")
    whole = calibrate.labelled_sample(table, labels, "quality", ~calibrate.held_out(4, 2), quality.terms_of)
    some = calibrate.labelled_sample(table, labels, "quality", ~calibrate.held_out(4, 2), quality.terms_of, most_bytes=50_000)
    one = calibrate.labelled_sample(table, labels, "quality", ~calibrate.held_out(4, 2), quality.terms_of, most_bytes=1)
    assert 1 == len(one.y) < len(some.y) < len(whole.y)


# ---------------------------------------------------------------- words that a polynomial hash confuses


def thue_morse(n, first):
    return "".join("ab"[(bin(i).count("1") + first) % 2] for i in range(n))


def test_long_words_are_not_confused(spark):
    a, b = thue_morse(2048, 0), thue_morse(2048, 1)
    pair = [a, b, f"{a} tail", f"{b} tail"]
    coder, path = token_store.encoder(queries.tokenizer_file()), queries.tokenizer_file()
    for t in pair:
        raw = np.frombuffer(t.encode(), np.uint8)
        ids, _ = coder.encode(raw, np.array([0, len(raw)]))
        assert ids.tolist() == token_store.tokenizer(path).encode(t, add_special_tokens=False).ids
    found = phrase_index.match_digests(phrase_index.decontaminate(docs(spark, pair), spark.createDataFrame([(1, a)], "item_id long, text string"))).collect()
    assert {r.doc_id for r in found if r.contaminated} == {0, 2}
    assert len({r.class_id for r in bagminhash.near_duplicates(docs(spark, [a, b])).collect()}) == 2
    assert len({h for t in (a, b, LONG) for h in token_store.span_hashes(np.frombuffer(t.encode(), np.uint8), np.array([0]), np.array([len(t)])).tolist()}) == 3
