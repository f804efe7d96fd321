"""Prefix trie, spelling variants and the Jaccard join against brute force and SQL on small fixtures."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from conftest import same_rows

from atlasforge.llm import partenum, prefix_trie, queries, spelling

CONVERSATIONS = "conv_id long, turn long, role string, text string, pos long, key string, parent string"


def sql_over(name, **tables):
    con = duckdb.connect()
    for t, frame in tables.items():
        con.register(f"raw_{t}", frame.toArrow())
        con.sql(f"create view {t} as select * from raw_{t}")
    return con.sql(queries.ORACLES[name])


# ---------------------------------------------------------------- op11


def odd_conversations(seed, n_convs=230, deep=0):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(-150, 420), n_convs):
        for t in range(r.choice([1, 1, 2, 3, 5, 8])):
            rows.append((c, r.choice([None, t, t, t + 1]), r.choice(["user", "assistant", None]), r.choice(["hi", "hi", "ünï", "", None, "a:b"])))
    for c in range(500, 505 if deep else 500):  # share more turns than a member carries, two of them to the end
        rows += [(c, t, "user", f"turn {t % 3}") for t in range(deep + (c % 4))]
    rows += rows[:40]  # repeated rows are turns
    rows += [(None, 0, "user", "lost")]
    r.shuffle(rows)
    return [(*row, 7, "k", "p") for row in rows]


def brute_trie(seqs):
    """seqs: conversation to its list of (key, characters)."""
    members = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members.setdefault(tuple(s[:d]), []).append(c)
    kids, out = {}, {}
    for path in members:
        if path:
            kids.setdefault(path[:-1], []).append(path)
    for path in sorted(members, key=len, reverse=True):
        own = (len(members[path]) - 1) * path[-1][1] if path else 0
        below = [out[k] for k in kids.get(path, [])]
        ends = ",".join(str(c) for c in sorted(members[path]) if len(seqs[c]) == len(path))
        parent = min(members[path[:-1]]) if path else None
        out[path] = (min(members[path]), len(path), parent, len(members[path]), len(below), sum(b[5] for b in below) or 1, own + sum(b[6] for b in below), hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values(), key=lambda x: x[:2])


NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def found(df):
    return sorted((tuple(r[c] for c in NODE) for r in df.collect()), key=lambda x: x[:2])


@pytest.mark.parametrize("deep", [0, 37])
def test_trie_like_sql_and_brute_force(spark, tmp_path, deep):
    df = spark.createDataFrame(odd_conversations(3, deep=deep), CONVERSATIONS)
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    got = queries.QUERIES["op11_prefix_trie"](spark, str(tmp_path))
    same_rows(got, sql_over("op11_prefix_trie", conversations=df))
    seqs = {}
    for row in prefix_trie.numbered(df).orderBy("conv_id", "pos").collect():
        seqs.setdefault(row.conv_id, []).append((bytes(row.key), row.n_chars))
    assert found(prefix_trie.trie(df)) == brute_trie(seqs)
    rebuilt = {}
    for c, s in seqs.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        rebuilt[c] = seqs.get(base, [])[:h] + s[h:]
    assert any(not s for s in rebuilt.values())
    assert found(got) == brute_trie(rebuilt)


def test_trie_of_copies_and_long_chains(spark, monkeypatch):
    """Long copies take one round; their lists of ids and their sums are put together from pieces."""
    monkeypatch.setattr(prefix_trie, "PIECE", 8)
    monkeypatch.setattr(prefix_trie, "IDS", 16)
    rows = [(c, t, "user", "x" * (t % 5)) for c in range(40) for t in range(60)] + [(99, t, "user", "other") for t in range(90)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    seqs = {}
    for c, t, _, text in rows:
        seqs.setdefault(c, []).append((text, len(text)))
    assert found(prefix_trie.trie(df)) == brute_trie(seqs)


def test_long_shared_prefixes_are_runs_and_not_rounds(spark, monkeypatch):
    """Members that share hundreds of turns: some end within, some part late, some twice."""
    monkeypatch.setattr(prefix_trie, "BLOCK", 2)
    monkeypatch.setattr(prefix_trie, "PIECE", 16)
    rounds = []
    refined = prefix_trie._refined

    def counted(*args):
        out = refined(*args)
        rounds.append(len(out[1]))
        return out

    monkeypatch.setattr(prefix_trie, "_refined", counted)
    base = [f"turn {t} {'x' * (t % 7)}" for t in range(300)]
    said = {1: base, 2: [*base[:290], "late"], 3: base[:250], 4: [*base[:290], "late", "later"], 5: [*base[:120], "early", *base[:60]], 6: [*base[:120], "early", *base[:59]], 7: base, 8: ["own"], 9: base[:2], 10: [*base[:250], "z"]}
    rows = [(c, t, "user", text) for c, texts in said.items() for t, text in enumerate(texts)]
    got = found(prefix_trie.trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    assert got == brute_trie({c: [(t, len(t)) for t in texts] for c, texts in said.items()})
    assert rounds[0] <= 16


def test_trie_of_nothing_and_of_one(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.shared_head_trie(empty).count() == 0
    one = spark.createDataFrame([(101, 0, "user", "gone")], "conv_id long, turn long, role string, text string")  # crc32("101") % 6 = 5: all of its turn is cut
    assert zlib.crc32(b"101") % 6 > 0
    assert found(prefix_trie.shared_head_trie(one)) == [(101, 0, None, 1, 0, 1, 0, hashlib.sha256(b"101").hexdigest())]
    ended = prefix_trie.last_turns(prefix_trie.trie(one), one).collect()
    assert sorted((r.depth, r.text) for r in ended) == [(0, None), (1, "gone")]


# ---------------------------------------------------------------- op12


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(counts):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 5 * counts[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), counts[w], len(near[w]), counts.get(form[w])) for w in counts)


def test_near_words_like_brute_force(spark):
    r = random.Random(1)
    counts = {"aaaaaa": 10, "aaaaaaa": 50, "aaaaba": 5, "aabaaaa": 5, "ààaaaa": 5, "àaaaaa": 250, "çççççç": 7, "÷×÷×÷×": 9, "÷×÷×÷": 9}
    for _ in range(1500):
        w = "".join(r.choice("abéÿ") for _ in range(r.randint(6, 9)))
        counts[w] = r.choice([5, 5, 6, 25, 30, 150, 1000])
    counts["z" * 3000] = 5
    counts["z" * 3001] = 25
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    near = spelling.near_words(words).collect()
    got = {x.word: (x.n_near, x.best.word) for x in near}
    for w in counts:
        vs = [v for v in counts if abs(len(v) - len(w)) <= 1 and one_edit(w, v)]
        assert got.get(w) == ((len(vs), min(vs, key=lambda v: (-counts[v], v))) if vs else None)


def test_deletion_keys_are_those_of_the_texts(spark):
    words = ["aabbcc", "éaébÿÿÿ", "abc", "x"]

    def keys(ws):
        raw = [w.encode() for w in ws]
        data = np.frombuffer(b"".join(raw), np.uint8)
        return spelling.deletion_keys(data, np.concatenate([[0], np.cumsum([len(x) for x in raw])]))

    key, who, begin, end = keys(words)
    left = [words[i] if b < 0 else words[i][:b] + words[i][b + 1 :] for i, b in zip(who, begin, strict=True)]
    again, _, place, _ = keys(left)
    assert key.tolist() == again[place < 0].tolist()
    assert all(len(set(words[i][b : e + 1])) == 1 for i, b, e in zip(who, begin, end, strict=True) if b >= 0)
    assert len(key) == sum(1 + len({w[:i] + w[i + 1 :] for i in range(len(w))}) for w in words)


def test_variants_like_brute_force_and_sql(spark, tmp_path):
    r = random.Random(2)
    base = ["".join(r.choice("abcdefgé") for _ in range(r.randint(5, 9))) for _ in range(60)] + ["ÀÉÎõüÿx", "q" * 90, "q" * 91]
    rows = []
    for i in range(700):
        said = [r.choice(base[: 1 + r.randint(0, len(base) - 1)]) for _ in range(r.randint(0, 60))]
        said = [w[: (k := r.randrange(len(w)))] + r.choice(["", "a", "é"]) + w[k + 1 :] if r.random() < 0.1 else w for w in said]
        rows.append((i if r.random() < 0.95 else None, r.choice([" ", "-", "1", "ß\n"]).join(said).upper() if i % 3 else " ".join(said), "n", "w"))
    rows += [(0, None, "n", "w"), (0, "", "n", "w"), rows[5], rows[5]]
    df = spark.createDataFrame(rows, "doc_id long, text string, n string, word string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["op12_spelling_variants"](spark, str(tmp_path))
    same_rows(got, sql_over("op12_spelling_variants", documents=df))
    counts = {}
    for i, text, *_ in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        run = ""
        for c in low + " ":
            if "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c
            elif run:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                w = run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]
                counts[w] = counts.get(w, 0) + 1
                run = ""
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    assert sorted(tuple(x) for x in got.select("word", "form", "root", "n", "n_near", "form_n").collect()) == brute_variants(counts)
    df.limit(0).write.parquet(str(tmp_path / "none/documents.parquet"))
    assert queries.QUERIES["op12_spelling_variants"](spark, str(tmp_path / "none")).count() == 0


# ---------------------------------------------------------------- op13


@pytest.mark.parametrize("edits,n_parts", [(1, 3), (2, 6), (3, 8)])
def test_similar_sets_share_a_signature(edits, n_parts):
    """No pair at or above the threshold is without a common signature, whatever the sizes."""
    r = np.random.default_rng(edits)
    for size in [1, 2, 5, 6, 7, 8, 9, 10, 13, 14, 19, 20, 33, 60, 150, 400, 1500, 6000]:
        for _ in range(40):
            a = r.integers(0, 1 << 63, size, dtype=np.uint64)
            # as many differences as the threshold allows: some only lost, some exchanged, some added
            lost = int(r.integers(0, max(1, size * 15 // 100 + 1)))
            added = max(0, int((size - lost) * 100 // 85 - size))
            b = np.concatenate([a[lost:], r.integers(0, 1 << 63, int(r.integers(0, added + 1)), dtype=np.uint64)])
            common, either = size - lost, len(b) + lost
            if common * 100 < either * 85 or common == either:
                continue
            key, of = partenum.signatures([np.unique(a), np.unique(b)], 85, edits, n_parts)
            assert set(key[of == 0].tolist()) & set(key[of == 1].tolist()), (size, lost, len(b))


def brute_components(ids, texts):
    sets = []
    for t in texts:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", w) if x]
        sets.append({tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set())
    label = list(ids)
    links = [(i, j) for i in range(len(ids)) for j in range(i) if ids[i] is not None and ids[j] is not None and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    moved = True
    while moved:
        moved = False
        for i, j in links:
            low = min(label[i], label[j])
            moved |= label[i] != low or label[j] != low
            label[i] = label[j] = low
    return sorted(((d, len(s), c) for d, s, c in zip(ids, sets, label, strict=True)), key=repr)


def near_texts(seed):
    r = random.Random(seed)
    long = " ".join(f"w{i % 977}" for i in range(20_000))
    texts = [None, "", " \n ", "one", "ONE", "two words", "a b c d", "a b c d e f g h i j k", "a b c d e f g h i j l", "\0 null \x7f byte", "Ünï cödé x", long, long + " more"]
    boilerplate = " ".join(f"law{i}" for i in range(60))
    for g in range(12):
        n = r.choice([5, 9, 12, 20, 40, 120, 300])
        base = [f"v{r.randint(0, 300)}" for _ in range(n)]
        for _ in range(r.randint(1, 12)):
            w = list(base)
            for _ in range(r.randint(0, max(1, n // 25))):
                w[r.randrange(len(w))] = f"x{r.randint(0, 99)}"
            texts.append(" ".join(w))
        texts.append(boilerplate + " " + " ".join(f"u{g}{i}" for i in range(r.randint(3, 30))))
    return texts


@pytest.mark.parametrize("bucket_pairs,levels", [(8, partenum.LEVELS), (1, partenum.LEVELS), (1, ((1, 3),))])
def test_components_like_brute_force(spark, bucket_pairs, levels):
    texts = near_texts(7)
    ids = [i * 3 for i in range(len(texts))]
    ids[5], ids[20], ids[30], ids[-1] = None, ids[21], ids[50], None  # repeated and missing ids
    rows = [(i, t, "n", "k", 1) for i, t in zip(ids, texts, strict=True)]
    df = spark.createDataFrame(rows + rows[40:42], "doc_id long, text string, node string, key string, n int")
    got = partenum.linked(df, bucket_pairs=bucket_pairs, levels=levels).collect()
    want = brute_components(ids + ids[40:42], texts + texts[40:42])
    assert sorted((tuple(x) for x in got), key=repr) == want


def test_a_large_group_of_near_copies(spark):
    """Texts of one group with changes that some of them share: some linked to the centre, some to others only, some to none."""
    r = random.Random(4)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(260):
        w = list(base)
        for _ in range(r.choice([0, 1, 2, 4, 6, 9, 14])):
            at = r.randrange(0, 150, 5)
            w[at] = r.choice([f"x{at}", f"y{at}", f"own{i}"])
        rows.append((i, " ".join(w)))
    assert len({t for _, t in rows}) > 200
    got = partenum.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(x) for x in got) == sorted(brute_components(*map(list, zip(*rows, strict=True))))
