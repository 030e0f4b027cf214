"""Operators on texts against plain versions, with odd rows: nulls, empty and long texts, repeated rows, names that clash."""

import hashlib
import random

import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from harness import compare, duckdb_connection
from pyspark.sql import functions as F

from tabulift.llm import bpe, common, fingerprints, line_dedup, packing, queries, simhash, substring_dedup, suffix_dedup

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark, folder):
    return [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def duck(folder):
    return duckdb_connection(folder)


def odd_texts():
    r = random.Random(5)
    common_part = " ".join(f"w{i}" for i in range(70))
    texts = [None, "", " ", "\n\n", "a", "one line\none line\none lime", "é日本👍", "x" * 30_000, "ab" * 40_000, common_part, f"start {common_part} end"]
    texts += [f"{common_part[:-3]}\nlast {i}" for i in range(4)] + ["Same text.", "Same text.", "same  TEXT.", "Ein ähnlicher Satz\nmit Zeile"]
    texts += [" ".join(r.choice("abcdefg") for _ in range(r.choice([3, 60, 130]))) for _ in range(12)]
    texts += ["<|endoftext|> it's  2024 \t\x1c\x85 ok", "क़İ, ΣΣ Ｋ"]
    return texts


def odd(spark, texts=None, ids=None):
    """Rows with columns whose names the operators use inside."""
    texts = odd_texts() if texts is None else texts
    rows = [(i, t, "x", 1, 2, "f", 3, 4) for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, key string, doc int, places int, fingerprint string, n_words int, value int").repartition(4)


OPERATORS = {
    "encode": lambda df: bpe.encode(df, RANKS, public_tokenizers.PATTERN),
    "pack": lambda df: packing.tokenize_and_pack(df, WORDS),
    "fingerprints": lambda df: fingerprints.fingerprints(df),
    "edits": lambda df: fingerprints.edit_likeness(df),
    "lines": lambda df: line_dedup.dedup_lines(df),
    "simhash": lambda df: simhash.near_duplicates(df),
    "one of each": lambda df: simhash.one_of_each(df),
    "substrings": lambda df: substring_dedup.dedup_substrings(df),
    "bytes": lambda df: suffix_dedup.dedup_bytes(df),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](odd(spark).limit(0)).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_null_keys_and_repeated_rows(spark, name):
    texts = ["one two three", None, "one two three", "", "one two three"]
    out = OPERATORS[name](odd(spark, texts, [None, None, 7, 7, 7])).collect()
    assert len(out) == 5 if name != "one of each" else 2 <= len(out) <= 5


def test_bpe_equals_library(spark):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    texts = odd_texts()
    df = odd(spark).withColumn("decoded", F.lit(1))
    out = {r["doc_id"]: list(r["ids"]) for r in bpe.encode(df, RANKS, public_tokenizers.PATTERN).collect()}
    assert out == {i: library.encode_ordinary(t or "") for i, t in enumerate(texts)}
    back = bpe.decode(bpe.encode(df, RANKS, public_tokenizers.PATTERN).withColumn("decoded", F.lit(1)), RANKS).collect()
    assert {r["doc_id"]: bytes(r["decoded_"]) for r in back} == {i: (t or "").encode() for i, t in enumerate(texts)}


def test_bpe_of_random_texts():
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    mine, r = bpe.Encoder(RANKS, public_tokenizers.PATTERN), random.Random(1)
    for _ in range(1500):
        text = "".join(r.choice("ab éß'st \n\t\x1c\x85 12٣,.|日👍ΣİＫthe") for _ in range(r.choice([1, 5, 30, 200])))
        assert mine(text).tolist() == library.encode_ordinary(text)


def test_bpe_splits_a_text_once():
    mine, texts = bpe.Encoder(RANKS, public_tokenizers.PATTERN), []

    class Pattern:
        def findall(self, text, whole=mine.pattern):
            texts.append(text)
            return whole.findall(text)

    mine.pattern = Pattern()
    mine("one two,\nthree  four")
    assert texts == ["one two,\nthree  four"]


def test_decode_of_null_and_unknown_ids(spark):
    df = spark.createDataFrame([(0, [64, 65]), (1, None), (2, []), (3, [66])], "n int, ids array<int>").coalesce(1)
    pieces = {rank: piece for piece, rank in bpe.read_ranks(RANKS).items()}
    out = {r["n"]: r["decoded"] and bytes(r["decoded"]) for r in bpe.decode(df, RANKS).collect()}
    assert out == {0: pieces[64] + pieces[65], 1: None, 2: b"", 3: pieces[66]}
    for unknown in (-1, max(pieces) + 1):
        with pytest.raises(Exception):
            bpe.decode(spark.createDataFrame([([unknown],)], "ids array<int>"), RANKS).collect()


def test_columns_of_arrays():
    kind = pa.list_(pa.field("element", pa.int32()))
    lists = tuple(np.arange(n, dtype="<u4") for n in (3, 0, 5))
    for values in (lists, lists[1:2], (lists[0], None), ([1, 2], [])):
        assert common._column(values, kind).equals(pa.array(values, kind))


def test_bpe_query(spark, folder, docs):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    rows = {r["doc_id"]: r for r in queries.op1(spark, folder).collect()}
    for d, t in docs:
        ids = library.encode_ordinary(t or "")
        assert rows[d]["n_tokens"] == len(ids)
        assert rows[d]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert rows[d]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def _library_ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_tokenizer_of_random_texts():
    mine, library, r = packing.Tokenizer(WORDS), _library_ids(), random.Random(2)
    for _ in range(1500):
        text = "".join(r.choice("ab éß'st \n\t\x1c\x85 12٣,.|日👍ΣİＫक़the") for _ in range(r.choice([1, 5, 30, 200])))
        assert mine(text) == np.array(library(text), "<u4").tobytes(), ascii(text)


def test_tokenizer_of_words_beside_signs():
    mine, library, r = packing.Tokenizer(WORDS), _library_ids(), random.Random(3)
    parts = [*"abZÉßªµ 12½²'.,|-()\"<>=&_日क\u0338\u0301\u200b\xad\xa0\n\t ", "<|endoftext|>", "<|ENDOFTEXT|>", "'s", "word", "Ünder"]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.choice([2, 5, 30, 200])))
        assert mine(text) == np.array(library(text), "<u4").tobytes(), ascii(text)


def test_a_word_is_encoded_once_beside_any_sign():
    mine, words = packing.Tokenizer(WORDS), []
    mine.merged = lambda word, whole=mine.merged: words.append(word) or whole(word)
    text = 'Über, word! (WORD) "word" word-word über.\nword; Word #word*'
    assert mine(text) == np.array(_library_ids()(text), "<u4").tobytes()
    assert sorted(words) == ["word", "Ã¼ber"]


def test_special_strings_are_the_librarys():
    assert np.frombuffer(packing.Tokenizer(WORDS)("hello <|endoftext|> there"), "<u4").tolist() == [3306, 49407, 997]


def test_packing(spark, folder, docs, monkeypatch):
    brute.check_packing(queries.op3(spark, folder).collect(), dict(docs), _library_ids())
    monkeypatch.setattr(packing, "RANKED", 3)
    texts = odd_texts() + ["same size"] * 40
    brute.check_packing(packing.tokenize_and_pack(odd(spark, texts), WORDS, size=64).collect(), dict(enumerate(texts)), _library_ids(), 64)


def test_packs_hold_the_histogram():
    r = random.Random(4)
    for _ in range(50):
        size = r.choice([8, 64, 512])
        histogram = {r.randint(1, size): r.randint(1, 50) for _ in range(r.randint(1, 40))}
        used = {}
        for pattern, packs in packing.plan_packs(histogram, size):
            assert sum(pattern) <= size and packs > 0
            for length in pattern:
                used[length] = used.get(length, 0) + packs
        assert used == histogram


def test_spans_and_extensions():
    r = random.Random(6)
    for _ in range(60):
        a, b = ("".join(r.choice("ab") for _ in range(r.randint(0, 40))) for _ in range(2))
        x, y = (fingerprints.Prefixes(fingerprints.code_points(t)) for t in (a, b))
        for _ in range(20):
            i, j, n = r.randint(0, len(a)), r.randint(0, len(b)), r.randint(0, 12)
            fits = i + n <= len(a) and j + n <= len(b)
            assert x.equal(i, y, j, n) == (fits and a[i : i + n] == b[j : j + n])
            k = 0
            while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                k += 1
            assert x.extension(i, y, j) == k


def test_likeness():
    r = random.Random(1)
    a = "".join(r.choice("abcdefgh ") for _ in range(3000))
    f = fingerprints.fingerprint
    assert fingerprints.likeness(f(a), f(a)) == 1 and fingerprints.likeness(f(""), f(None)) == 1
    assert fingerprints.likeness(f(a), f("")) == 0
    assert fingerprints.likeness(f(a), f(a[::-1])) < 0.05
    assert 0.55 < fingerprints.likeness(f(a), f(a[:2000] + a[:1000])) <= 2 / 3 + 0.01
    assert fingerprints.likeness(f(a), f(a[:1500] + "x" + a[1500:])) > 0.8


def test_likeness_of_scattered_edits(spark):
    r, f = random.Random(2), fingerprints.fingerprint
    a = "".join(r.choice("abcdefgh 日é") for _ in range(6000))
    edits = {
        "around": f"x{a}y",
        "near the ends": f"{a[:100]}x{a[101:-100]}y{a[-99:]}",
        "scattered": "".join(f"{a[i : i + 1000]}{'' if i % 2000 else 'z'}" for i in range(0, 6000, 1000))[1:],
    }
    for name, b in edits.items():
        for x, y in ((a, b), (b, a)):
            assert 0.85 < fingerprints.likeness(f(x), f(y)) < 1, name
    rows = fingerprints.edit_likeness(odd(spark, [edits["near the ends"], a]))
    assert all(row["near_next"] > 0.9 for row in rows.collect())
    for t in ("x" * 200_000, "ab" * 70_000, a, "", "short"):
        ends = fingerprints.span_ends(fingerprints.code_points(t)).tolist()
        sizes = [j - i for i, j in zip([0, *ends], ends)]
        assert sum(sizes) == len(t) and all(0 < n <= fingerprints.MOST for n in sizes)


def test_edits(spark):
    texts = odd_texts()
    rows = {r["doc_id"]: r for r in fingerprints.edit_likeness(odd(spark)).collect()}
    order = sorted(range(len(texts)), reverse=True)
    for d, after in zip(order, order[1:] + order[:1]):
        t, u = texts[d] or "", texts[after] or ""
        edited = t[: len(t) - len(t) // 3] + u[: len(t) // 3]
        a, b, c = map(fingerprints.fingerprint, (t, edited, u))
        assert rows[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert (rows[d]["n_chars"], rows[d]["fingerprint"], rows[d]["edited_fingerprint"]) == (len(t), a, b)
        assert (rows[d]["near_edited"], rows[d]["near_next"]) == (fingerprints.likeness(a, b), fingerprints.likeness(a, c))


def test_line_dedup_sql(spark, folder, duck):
    assert compare(queries.op2(spark, folder), duck, queries.SQL["op2_line_dedup"]) is None


@pytest.mark.parametrize("longest", [4, 64])
def test_line_dedup(spark, monkeypatch, longest):
    monkeypatch.setattr(line_dedup, "LONGEST", longest)
    r = random.Random(8)
    texts = odd_texts() + ["\n".join("".join(r.choice("ab") for _ in range(r.randint(0, 7))) for _ in range(6)) for _ in range(25)]
    base = "".join(r.choice("abcdefgh ") for _ in range(400))
    for _ in range(30):  # one and two edits at any place
        x = list(base)
        for _ in range(r.choice([1, 1, 2])):
            i = r.randrange(len(x))
            x[i : i + r.randint(0, 1)] = r.choice(["", "z", "y"])
        texts.append("".join(x))
    out = {r["doc_id"]: r for r in line_dedup.dedup_lines(odd(spark, texts)).collect()}
    expected = brute.dedup_lines(list(enumerate(texts)))
    for d, t in enumerate(texts):
        if t is None:
            assert out[d]["text"] is None and out[d]["n_lines"] == 0
        else:
            assert (out[d]["n_lines"], out[d]["n_removed"], out[d]["text"]) == expected[d], d
    assert set(odd(spark).columns) <= set(out[0].asDict())


def test_one_inserted_character_at_every_length(spark):
    r = random.Random(13)
    texts = []
    for n in range(200, 1101):
        line = "".join(r.choice("abcdefgh ") for _ in range(n))
        i = r.randint(0, n)
        texts.append("\n".join(r.sample([line, f"{line[:i]}z{line[i:]}"], 2)))
    out = {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup_lines(odd(spark, texts)).collect()}
    assert [200 + d for d in range(len(texts)) if out[d] != 1] == []


def test_simhash_query(spark, folder, docs):
    values = {d: brute.simhash(t) for d, t in docs}
    groups = brute.components(values)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op6(spark, folder).collect()} == {
        d: (f"{v:016x}", groups[d]) for d, v in values.items()
    }


@pytest.mark.parametrize("short", [1, 3, 64])
def test_simhash_links(spark, monkeypatch, short):
    monkeypatch.setattr(simhash, "SHORT_LIST", short)
    r, values = random.Random(3), {0}
    for _ in range(40):
        v = r.choice([r.getrandbits(64), r.choice(sorted(values))])
        for _ in range(r.randint(0, 5)):
            v ^= 1 << r.randrange(64)
        values.add(v)
    signed = {v - (1 << 64) if v >> 63 else v for v in values}
    found = common.components(simhash.links(spark.createDataFrame([(v,) for v in signed], "value bigint"))).collect()
    mine = {v: v for v in signed} | {r["node"]: r["component"] for r in found}
    assert mine == _signed_components(signed)


def _signed_components(signed):
    root = {v: v for v in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in signed:
        for b in signed:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {v: find(v) for v in signed}


def test_simhash_odd_rows(spark):
    texts = odd_texts()
    values = {i: brute.simhash(t) for i, t in enumerate(texts)}
    out = simhash.near_duplicates(odd(spark)).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in out} == {i: (f"{values[i]:016x}", c) for i, c in brute.components(values).items()}
    left = {r["doc_id"] for r in simhash.one_of_each(odd(spark)).collect()}
    assert left == set(brute.components(values).values())


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(200, 200)]
    out = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert out == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 140)}


def test_substring_sql(spark, folder, duck):
    assert compare(queries.op8(spark, folder), duck, queries.SQL["op8_substring_dedup"]) is None


@pytest.mark.parametrize("buffer", [50, 1 << 20])
def test_substrings(spark, monkeypatch, buffer):
    monkeypatch.setattr(substring_dedup, "BUFFER", buffer)
    r = random.Random(9)
    words = [f"w{r.randrange(400)}" for _ in range(600)]
    texts = odd_texts() + [
        "\t".join([f"p{i}"] * r.randint(0, 40) + words[(a := r.randrange(500)) : a + r.randint(45, 120)] + ["q"] * r.randint(0, 70)) for i in range(25)
    ]
    out = {r["doc_id"]: r for r in substring_dedup.dedup_substrings(odd(spark, texts)).collect()}
    for d, (n, gone, kept) in brute.dedup_windows(list(enumerate(texts))).items():
        left = out[d]["text"]
        assert (out[d]["n_words_"], out[d]["n_removed"], [w.decode() for w in substring_dedup.words_of(left)]) == (n, gone, kept), d
        assert gone or left == texts[d]


def test_every_shift_shares_an_anchor():
    p, c = substring_dedup.PERIOD, set(substring_dedup.COVER)
    assert all(any((i + s) % p in c and (j + s) % p in c for s in range(p)) for i in range(p) for j in range(p))


def test_suffix_sql(spark, folder, duck):
    assert compare(queries.op9(spark, folder), duck, queries.SQL["op9_suffix_dedup"]) is None


@pytest.mark.parametrize("shard,part", [(1 << 21, 20_000), (600, 20_000), (1 << 21, 2)])
def test_bytes(spark, monkeypatch, shard, part):
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", shard)
    monkeypatch.setattr(suffix_dedup, "PART", part)
    r = random.Random(10)
    shared = "".join(r.choice("abcdé ") for _ in range(900))
    texts = odd_texts() + ["no" * 90] + [
        "".join(r.choice("xyz") for _ in range(r.randint(0, 30))) + shared[(a := r.randrange(600)) : a + r.randint(180, 420)] + str(r.random()) for _ in range(25)
    ]
    out = {r["doc_id"]: r for r in suffix_dedup.dedup_bytes(odd(spark, texts)).collect()}
    for d, expected in enumerate(brute.dedup_bytes(texts)):
        assert (out[d]["n_bytes"], out[d]["n_removed"], out[d]["n_spans"], bytes(out[d]["kept"])) == expected, d


def shared_keys():
    """Rows of which some have one key and different texts."""
    r = random.Random(14)
    words = [f"w{r.randrange(400)}" for _ in range(200)]
    long_ = " ".join(words)
    texts = [(1, long_), (5, f"two more {long_}"), (5, "short text"), (5, long_), (7, f"{long_[300:]} end"), (7, None), (7, "x" * 450), (7, "x" * 450)]
    return texts + [(8, f"start {long_}"), (8, f"another start {long_}"), (9, "y " * 300), (9, "y " * 300)]


def test_words_of_shared_keys(spark):
    rows = shared_keys()
    windows = [[tuple(w[i : i + 50]) for i in range(len(w) - 49)] for w in ((t or "").split() for _, t in rows)]
    expected = []
    for n, (d, t) in enumerate(rows):
        earlier = {x for (e, _), ws in zip(rows, windows) if e < d for x in ws}
        gone = {i + k for i, x in enumerate(windows[n]) if x in earlier for k in range(50)}
        words = (t or "").split()
        expected.append((d, len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    out = substring_dedup.dedup_substrings(df).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], " ".join((r["text"] or "").split())) for r in out) == sorted(expected)


def test_bytes_of_shared_keys(spark):
    rows = shared_keys()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    out = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup.dedup_bytes(df).collect()]
    assert sorted(out) == sorted((d, *x) for (d, _), x in zip(rows, brute.dedup_bytes([t for _, t in rows])))


@pytest.mark.parametrize("later", [False, True])
@pytest.mark.parametrize("size", [1, 2, 7, 1000])
def test_hashes_over_several_batches(later, size):
    r = random.Random(15)
    rows = sorted((r.randrange(4), 0, r.randrange(6), r.randrange(2), r.choice([b"", b"abcd", b"efgh"])) for _ in range(60))
    batches = [pa.RecordBatch.from_pylist([dict(zip(substring_dedup.MET.names, x)) for x in rows[i : i + size]], substring_dedup.MET) for i in range(0, 60, size)]
    found = sorted(x for b in substring_dedup._settle(later)(iter(batches)) for x in zip(*(c.to_pylist() for c in b.columns)))
    expected = []
    for h, _, doc, variant, places in rows:
        group = [x for x in rows if x[0] == h]
        docs = {x[2] for x in group}
        counts = doc > min(docs) if later else len(docs) > 1 or any(not x[4] for x in group)
        if counts and places:
            expected.append((doc, variant, places))
    assert found == sorted(expected)


def test_short_near_copies_are_alike():
    r, f = random.Random(16), fingerprints.fingerprint
    for n, edits, least in ((60, 1, 0.5), (150, 2, 0.6), (300, 4, 0.6), (300, 8, 0.3), (600, 4, 0.75), (1000, 4, 0.8), (4000, 8, 0.7), (50_000, 8, 0.7)):
        for _ in range(5):
            a = "".join(r.choice("abcdefghijklmno ") for _ in range(n))
            b = list(a)
            for i in r.sample(range(n), edits):
                b[i] = "#"
            b = "".join(b)
            found = fingerprints.likeness(f(a), f(b))
            assert least < found <= 1 - edits / n + 1e-9, (n, edits, found)
            assert len(f(a)) < 4000


def test_suffix_array_and_prefixes():
    r = random.Random(11)
    for _ in range(40):
        data = np.array([r.choice([1, 2, 3]) for _ in range(r.randint(1, 300))] + [0], np.int16)
        order = suffix_dedup.suffix_array(data)
        raw = [bytes(data[i:].astype(np.uint8)) for i in range(len(data))]
        assert order.tolist() == sorted(range(len(data)), key=lambda i: raw[i])
        prefixes = suffix_dedup.common_prefixes(data, order, 1000)
        for a, b in zip(order, order[1:]):
            n = 0
            while max(a, b) + n < len(data) and data[a + n] == data[b + n]:
                n += 1
            assert prefixes[b] == n


def agree(data, a, b):
    n = 0
    while max(a, b) + n < len(data) and data[a + n] == data[b + n]:
        n += 1
    return n


def test_order_and_prefixes_of_wanted_suffixes():
    r = random.Random(17)
    for _ in range(200):
        unit, most = [r.randint(1, 3) for _ in range(r.randint(1, 12))], r.choice([8, 14, 20, 50])
        data = np.array([r.choice([r.randint(0, 3), *unit[i % len(unit) :][:1] * 4]) for i in range(r.randint(1, 200))] + [0], np.int16)
        wanted = np.array([r.random() < 0.5 for _ in data])
        order, rank = suffix_dedup.refined(data, most, wanted)
        assert sorted(order.tolist()) == np.flatnonzero(wanted).tolist()
        prefixes = suffix_dedup.common_prefixes(data, order, most, rank)
        for a, b in zip(order.tolist(), order.tolist()[1:]):
            assert data[a : a + most].tolist() <= data[b : b + most].tolist()
            if max(a, b) + most <= len(data):
                assert prefixes[b] == min(agree(data, a, b), most)
                assert (rank[a] == rank[b]) == (prefixes[b] == most)
        assert not prefixes[~wanted].any()


def test_prefixes_that_follow_are_not_compared(monkeypatch):
    r, compared, agreeing = random.Random(18), [], suffix_dedup._agreeing
    monkeypatch.setattr(suffix_dedup, "_agreeing", lambda data, places, others: compared.append(len(places)) or agreeing(data, places, others))
    copies = [bytes(r.choice(b"abcdefgh") for _ in range(2_000))] * 10
    data = np.frombuffer(b"".join(bytes([200 + i]) + c for i, c in enumerate(copies)), np.uint8).astype(np.int16)
    order, rank = suffix_dedup.refined(data, 200)
    prefixes = suffix_dedup.common_prefixes(data, order, 200, rank)
    assert sum(compared) < len(data) / 5  # most places follow from the one before them or have the rank of the suffix before
    assert [prefixes[b] for b in order[1:]] == [min(agree(data, a, b), 200) for a, b in zip(order, order[1:])]


def test_texts_hashed_together_and_alone():
    r = random.Random(19)
    raws = [b"a" * 200, b"ab" * 100, b"a" * 700, *(bytes(r.choice(b"abc") for _ in range(r.randint(200, 900))) for _ in range(20)), b"a" * 201, b"ab" * 100]
    f, context, of, first, n = suffix_dedup.contexts(raws, 200)
    for k, raw in enumerate(raws):
        alone = suffix_dedup.contexts([raw], 200)
        assert all((x[of == k] == y).all() for x, y in zip((f, context, first, n), (*alone[:2], *alone[3:])))
        assert n[of == k].sum() == len(raw) - 199


def test_bytes_removed_of_several_texts():
    r = random.Random(20)
    raws, spans = [], []
    for _ in range(400):
        n = r.choice([0, 3, 8, 40, 200])
        raws.append(bytes(r.randrange(256) for _ in range(n)))
        spans.append([(a := r.randint(0, n - 8), r.randint(a + 1, n - 7)) for _ in range(r.randint(0, 3))] if n >= 8 else [])
    of, starts, ends = np.array([(k, a, b) for k, found in enumerate(spans) for a, b in found]).T
    for raw, found, out in zip(raws, spans, zip(*suffix_dedup.without_bytes(raws, of, starts, ends, 8))):
        gone = [any(a <= i < b + 7 for a, b in found) for i in range(len(raw))]
        runs = sum(x and not y for x, y in zip(gone, [False, *gone]))
        assert out == (sum(gone), runs, bytes(c for c, x in zip(raw, gone) if not x))
    none = np.zeros(0, np.int64)
    assert suffix_dedup.without_bytes([], none, none, none, 8) == ([], [], [])


@pytest.mark.parametrize("cuts", [(12,), (5, 8, 12)])
def test_shards_merge(cuts):
    r = random.Random(12)
    for _ in range(30):
        w = r.choice([5, 8, 16])
        texts = [bytes(r.choice(b"ab") for _ in range(w - 1 + r.randint(1, 30))) for _ in range(12)]
        shards = [([*texts[a:b]], [len(t) - w + 1 for t in texts[a:b]]) for a, b in zip((0, *cuts), cuts)]
        found = suffix_dedup.repeated_in(shards, w)
        every = [t[i : i + w] for t in texts for i in range(len(t) - w + 1)]
        for t, spans in zip(texts, found):
            marked = {i for a, b in spans for i in range(a, b)}
            assert marked == {i for i in range(len(t) - w + 1) if every.count(t[i : i + w]) > 1}
