"""Spelling variants, the Merkle manifest and the n-gram join against plain versions, with odd rows and lowered limits."""

import random

import brute
import numpy as np
import pytest
from harness import compare, duckdb_connection
from pyspark.sql import functions as F

from tabulift.llm import merkle, ngram_join, queries, spelling

FIELDS = "doc_id bigint, source string, lang string, n_chars bigint, text string, word string, label bigint, token int, digest string, steps int"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def table(spark, rows):
    """Rows of (doc_id, source, lang, n_chars, text) with columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, "w", 1, 2, "d", 3) for r in rows], FIELDS).repartition(4)


def texts_of(spark, pairs):
    return table(spark, [(d, "s", "en", 1, t) for d, t in pairs])


@pytest.mark.parametrize("name", ["op11_spelling", "op12_merkle", "op13_ngram_join"])
def test_same_rows_as_sql(spark, folder, name):
    assert compare(queries.QUERIES[name](spark, folder), duckdb_connection(folder), queries.SQL[name]) is None


# ---- spelling variants ----


def near(a, b):
    return brute.within_one_edit(a, b) and a != b


@pytest.mark.parametrize("seed", range(6))
def test_lists_find_all_near_words(seed):
    r = random.Random(seed)
    words = sorted({"".join(r.choice("abÿ" if seed % 2 else "ab") for _ in range(r.randint(1, 7))) for _ in range(90)})
    group = np.sort(np.array([r.randint(0, 2) for _ in words]))
    words = [w for g in range(3) for w in sorted(words[i] for i in np.flatnonzero(group == g))]
    listed = np.array([r.random() < 0.7 for _ in words])
    asking = np.array([r.random() < 0.7 for _ in words])
    q, s = spelling.near_in(group, words, listed, asking, np.zeros(len(words), int))
    expected = {
        (i, j) for i in range(len(words)) for j in range(len(words)) if group[i] == group[j] and asking[i] and listed[j] and near(words[i], words[j])
    }
    assert sorted(zip(q.tolist(), s.tolist())) == sorted(expected)


@pytest.mark.parametrize("chunk,batch", [(1 << 15, 1 << 15), (5, 1 << 15), (5, 7)])
def test_near_words_once(spark, monkeypatch, chunk, batch):
    monkeypatch.setattr(spelling, "CHUNK", chunk)
    monkeypatch.setattr(spelling, "BATCH_WORDS", batch)
    r = random.Random(4)
    words = {"aaaaa", "aaaaaa", "aaaaaaa", "x" * 3000, "x" * 3001, "x" * 1500 + "y" + "x" * 1499, "élève", "eleve", "élèves"}
    words |= {"".join(r.choice("ab") for _ in range(r.randint(5, 8))) for _ in range(150)}
    n = {w: i + 1 for i, w in enumerate(sorted(words))}
    found = [tuple(x) for x in spelling.near_words(spark.createDataFrame(list(n.items()), "word string, n bigint")).collect()]
    assert sorted(found) == sorted((a, b, n[b]) for a in words for b in words if near(a, b))


def spelled():
    r = random.Random(6)
    base = ["language", "spelling", "Ölstand", "naïve", "groups", "ÀÖØöøÿ"]

    def slip(w):
        i = r.randrange(len(w))
        return w[:i] + r.choice(["", "q", "é"]) + w[i + r.randint(0, 1) :]

    texts = [" ".join(slip(w) if r.random() < 0.4 else r.choice([w, w.upper(), w.title()]) for w in r.choices(base, k=30)) for _ in range(40)]
    return texts + [None, "", "123 4_5", "same words same words", "same words same words", "ab" * 20_000, "word-word's×word÷word"] * 2


@pytest.mark.parametrize("slip_every", [None, 3, 97])
def test_variants(spark, slip_every):
    docs = [*enumerate(spelled()), (None, "language language language languages")]
    found = spelling.spelling_variants(texts_of(spark, docs), slip_every=slip_every)
    assert rows_of(found) == sorted(brute.spelling(docs, slip_every=slip_every), key=str)


def test_roots_of_long_chains(spark):
    words = ["aaaaa" + "b" * i for i in range(12)]
    vocabulary = spark.createDataFrame([(w, 2**i) for i, w in enumerate(words)], "word string, n bigint")
    out = {r["word"]: (r["form"], r["root"]) for r in spelling.variants(vocabulary).collect()}
    assert out == {w: (x, words[-1]) for w, x in zip(words, [*words[1:], None])}


def test_ties_take_the_smallest_word(spark):
    vocabulary = spark.createDataFrame([("words", 1), ("wordz", 5), ("wordé", 5), ("zords", 5)], "word string, n bigint")
    out = {r["word"]: tuple(r)[1:] for r in spelling.variants(vocabulary).collect()}
    assert out["words"] == ("wordz", "wordz", 1, 3, 5)
    assert out["wordz"] == (None, "wordz", 5, 2, None)


def test_no_words(spark):
    assert spelling.spelling_variants(texts_of(spark, [(1, None)]).limit(0)).count() == 0
    assert spelling.spelling_variants(texts_of(spark, [(1, None), (2, "a b")])).count() == 0


# ---- Merkle manifest ----


def prove(df):
    """What the query does, over any table."""
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    cut = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    rows = df.select("*", merkle.leaf_digest(*fields, F.col("text")).alias("original"), merkle.leaf_digest(*fields, cut).alias("tampered"))
    return merkle.prove(rows, F.col("original"), "source", "doc_id", ("tampered",))


def shown(proven):
    folded = proven.withColumn("folded", merkle.as_hex(merkle.folded("tampered", "siblings", "steps")))
    proof = F.sha2(merkle.as_hex(F.col("siblings")), 256)
    return rows_of(folded.select("doc_id", "leaf", "subroot", "root", proof, "folded", F.col("folded") == F.col("root")))


def odd_documents():
    r = random.Random(7)
    rows = [(i, r.choice(["a", "a", "a", "b", "é", ""]), r.choice([None, "en"]), r.choice([None, 3]), f"line {i}\nmore") for i in range(150)]
    rows += [(7, None, None, None, None), (None, None, "x", 1, "\n"), (None, "a", None, 1, "t"), (1000, "alone", "x", 1, ""), (1001, None, "x", 1, "y\n" * 40_000)]
    return rows + [(500, "copies", "en", 5, "a\nb")] * 40 + [(500, "copies", "en", 5, "other")] * 2 + [(i, f"own {i}", "l", 1, "t") for i in range(30)]


@pytest.mark.parametrize("height", [1, 2, 6])
def test_proofs(spark, monkeypatch, height):
    monkeypatch.setattr(merkle, "HEIGHT", height)
    monkeypatch.setattr(merkle, "WIDTH", 3**height)
    docs = odd_documents()
    assert shown(prove(table(spark, docs))) == sorted(brute.merkle(docs), key=str)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28])
def test_sizes_of_one_group(spark, monkeypatch, n):
    monkeypatch.setattr(merkle, "HEIGHT", 1)
    monkeypatch.setattr(merkle, "WIDTH", 3)
    docs = [(i, "s", "en", 1, f"{i}\n") for i in range(n)]
    assert shown(prove(table(spark, docs))) == sorted(brute.merkle(docs), key=str)


def test_no_documents(spark):
    assert prove(table(spark, [(1, "s", "l", 1, "t")]).limit(0)).count() == 0


def test_records_lead_from_the_root_to_every_leaf(spark):
    docs = odd_documents()
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    tree = merkle.manifest(table(spark, docs), merkle.leaf_digest(*fields), "source", "doc_id")
    children = {bytes(r["digest"]): bytes(r["children"]) for r in tree.records().collect()}
    (root,) = tree.root().collect()
    reached, open_ = set(), [bytes(root["digest"])]
    while open_:
        node = open_.pop()
        if node in children:
            assert merkle._parent(children[node]) == node
            open_ += [children[node][i : i + 32] for i in range(0, len(children[node]), 32)]
        else:
            reached.add(node.hex())
    assert reached == {row[1] for row in brute.merkle(docs)}


def test_clashing_names_of_proofs(spark):
    df = table(spark, odd_documents()[:20])
    out = merkle.prove(df, merkle.leaf_digest(F.col("doc_id")), "source", "doc_id", ("steps", "digest"))
    assert out.columns == ["doc_id", "source", "steps", "digest", "leaf", "subroot", "root", "rank", "siblings", "steps_"]


# ---- n-gram join ----


def near_copies(seed=8, groups=6, copies=14):
    r = random.Random(seed)
    texts = []
    for g in range(groups):
        base = [f"{g}w{r.randrange(300)}" for _ in range(r.choice([12, 60, 200]))]
        for _ in range(copies):
            words = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 18))):
                words[r.randrange(len(words))] = f"x{r.randrange(10**6)}"
            texts.append(" ".join(words).upper() if r.random() < 0.2 else "\t".join(words))
    passage = " ".join(f"p{i}" for i in range(40))
    texts += [f"{passage} {' '.join(f'{i}y{j}' for j in range(10))}" for i in range(20)]
    return texts + [None, "", " \n", "one", "One", "one two three", "one two three four", "one two\x1cthree", "a " * 50_000, "a a a a", texts[0], texts[0]]


@pytest.mark.parametrize("stars,sent", [(0, 1 << 17), (2, 1 << 17), (1, 2)])
def test_similar_documents(spark, monkeypatch, stars, sent):
    monkeypatch.setattr(ngram_join, "STARS", stars)
    monkeypatch.setattr(ngram_join, "SENT_SETS", sent)
    docs = list(enumerate(near_copies()))
    assert rows_of(ngram_join.similar_documents(texts_of(spark, docs))) == sorted(brute.similar(docs), key=str)


@pytest.mark.parametrize("rule", [(1, 50, 100), (2, 2, 3), (3, 1, 1)])
def test_other_rules(spark, rule):
    docs = list(enumerate(near_copies(9, 4, 8)))
    found = ngram_join.similar_documents(texts_of(spark, docs), ngram_join.Rule(*rule))
    assert rows_of(found) == sorted(brute.similar(docs, *rule), key=str)


def test_keys_of_several_rows(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    docs = [(5, a), (5, b), (3, a), (9, b), (None, a), (None, None), (7, None), (7, "z"), (8, "z")]
    out = rows_of(ngram_join.similar_documents(texts_of(spark, docs)))
    expected = [(5, 27, 3), (5, 27, 3), (3, 27, 3), (9, 27, 3), (None, 27, None), (None, 0, None), (7, 0, 7), (7, 1, 7), (8, 1, 7)]
    assert out == sorted(expected, key=str)


def test_no_rows_to_join(spark):
    assert ngram_join.similar_documents(texts_of(spark, [(1, "x")]).limit(0)).count() == 0


def test_filters_lose_no_pair(spark):
    r, rule, pairs = random.Random(10), ngram_join.Rule(), []
    common = np.zeros(1 << ngram_join.COUNTER_BITS, np.uint8)
    for _ in range(300):
        a = {r.getrandbits(64) for _ in range(r.randint(1, 120))}
        b = set(r.sample(sorted(a), r.randint(len(a) * 8 // 10, len(a)))) | {r.getrandbits(64) for _ in range(r.randint(0, 12))}
        a, b = (np.array(sorted(x), np.uint64) for x in (a, b))
        both = len(np.intersect1d(a, b))
        linked = 100 * both >= 85 * (len(a) + len(b) - both)
        ranges = [np.bincount((x % np.uint64(64)).astype(int), minlength=64).tolist() for x in (a, b)]
        pairs.append((*ranges, a.view(np.int64).tolist(), b.view(np.int64).tolist(), len(a) + len(b), linked))
        if linked:
            fronts = [ngram_join.rare_first(x, common)[: len(x) - rule.least_size(len(x)) + 1].tolist() for x in (a, b)]
            first = min(fronts[0].index(t) * 1000 + fronts[1].index(t) for t in set(fronts[0]) & set(fronts[1]))
            left = min(len(a) - first // 1000, len(b) - first % 1000)
            assert left >= rule.overlap(len(a) + len(b))
    df = spark.createDataFrame(pairs, "x array<int>, y array<int>, a array<bigint>, b array<bigint>, n int, linked boolean")
    may = ngram_join._may_link(rule, F.col("x"), F.col("y"), F.col("n"))
    does = ngram_join._linked(rule, F.col("a"), F.col("b"), F.col("n"))
    assert 50 < sum(p[-1] for p in pairs) < 280
    assert all(m or not linked for m, linked in df.select(may, "linked").collect())
    assert all(d == linked for d, linked in df.select(does, "linked").collect())
