"""Source audit, spelling variants and token files against plain computations."""

import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tokenizers
from helpers import awkward, docs_of, prose
from pyspark.sql import functions as F

from levelcast.llm import source_audit, spelling, token_files

BPE = public_tokenizers.path("byte_bpe_50k.json")
A_Z = {c: c + 32 for c in range(65, 91)}


def brute_audit(rows, min_docs, top):
    """rows: (lang, source, text)."""
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        found = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(A_Z))
        counts[lang or "", source or ""].update(found)
        docs[lang or ""].update(set(found))
    out = []
    for lang in {k for k, _ in counts}:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        groups = {s: counts[l, s] for l, s in counts if l == lang}
        whole = sum(groups.values(), Counter())

        def p(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        f = lambda x, y: (x - y) ** 2 // (x + y)
        ps, q = {s: p(c) for s, c in groups.items()}, p(whole)
        for s in groups:
            pair = [(o, sum(f(ps[s][t], ps[o][t]) for t in kept)) for o in groups if o != s]
            term = [(t, f(ps[s][t], q[t])) for t in kept if groups[s][t] and ps[s][t] > q[t]]
            for part, items, last in (("pair", pair, None), ("term", term, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, k + 1) for k, (i, v) in enumerate(items[:last])]
    return sorted(out)


def texts_of(seed, n, size=60):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("stone", "Étude", "über", "the", "río") for b in "abcdefghijkl"]
    return [" ".join(rng.choice(words) for _ in range(rng.randrange(size))) for _ in range(n)]


@pytest.mark.parametrize("entries", [300_000, 50])
def test_audit_equals_a_plain_computation(spark, entries, monkeypatch):
    monkeypatch.setattr(source_audit, "ENTRIES", entries)
    rng = random.Random(4)
    rows = [(rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "é", None]), t) for t in texts_of(1, 200)]
    rows += [("fr", "only", "un deux"), ("xx", "p", None), ("xx", "q", "1 2 3")] + rows[:5]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").withColumn("term", F.lit(1))
    got = sorted(tuple(r) for r in source_audit.audit_sources(docs, min_docs=5, top=4).collect())
    assert got == brute_audit(rows, 5, 4)
    assert {("xx", "p", "pair", "q", 0, 1), ("xx", "q", "pair", "p", 0, 1)} <= set(got)


def test_audit_cuts_a_large_cell_in_utf8_order(spark):
    words = [f"w{a}{b}" for a in "éabz" for b in "qrstuvwxyz"]
    rows = [("en", "a", " ".join(words)), ("en", "b", "other " * 3), ("en", "b", "w")]
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    got = source_audit.audit_sources(docs, min_docs=1, top=10).filter("part = 'term' AND source = 'a'").orderBy("rank").collect()
    assert [r["item"] for r in got] == sorted(words, key=str.encode)[:10] and len({r["value"] for r in got}) == 1


def test_audit_counts_beyond_64_bits(spark):
    big = 40_000_000_000
    cell = spark.createDataFrame([(big, 3 * big, 5)], "n bigint, total bigint, terms bigint")
    want = 1 + 10**9 * (big + 2) // (3 * big + 10)
    assert cell.select(source_audit._p("n", "total", "terms").alias("p")).first()["p"] == want


def test_audit_awkward_rows(spark):
    docs = awkward(spark)
    got = sorted(tuple(r) for r in source_audit.audit_sources(docs, min_docs=2).collect())
    assert got == brute_audit([(r["lang"], r["source"], r["text"]) for r in docs.collect()], 2, 10)
    assert source_audit.audit_sources(docs.limit(0)).count() == 0


# -- spelling ----------------------------------------------------------------


def brute_words(rows, min_length, min_count, every):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(A_Z)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= min_length and n >= min_count}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(words):
    near = {w: [o for o in words if one_edit(w, o)] for w in words}
    best = {w: min(os, key=lambda o: (-words[o], o)) for w, os in near.items() if os}
    form = {w: o for w, o in best.items() if words[o] >= 2 * words[w]}
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return sorted(out, key=lambda r: r[0])


def variants_of(spark, df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[0])


@pytest.mark.parametrize("limit,alphabet", [(4096, "abcé"), (3, "abcé"), (1, "ab"), (7, "xyzßabcdefgh")])
def test_variants_equal_a_plain_computation(spark, limit, alphabet):
    rng = random.Random(limit)
    pool = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(3, 10))) for _ in range(150)] + ["a" * k for k in range(3, 40)]
    rows = [(i, " ".join(rng.choice(pool[: rng.randrange(1, len(pool))]).title() for _ in range(60)) + ". 1x") for i in range(40)]
    df = spelling.spelling_variants(docs_of(spark, rows), min_length=4, min_count=2, every=5, limit=limit)
    words = brute_words(rows, 4, 2, 5)
    assert len(words) > 50 and variants_of(spark, df) == brute_variants(words)


def test_near_words_come_once_and_lists_stay_short(spark):
    rng = random.Random(3)
    pool = sorted({"common" + "".join(rng.choice("abcdefgh") for _ in range(rng.choice((4, 5)))) for _ in range(900)})
    words = spark.createDataFrame([(w, 3 + k) for k, w in enumerate(pool)], "word string, n bigint")
    got = [tuple(r) for r in spelling.near_words(words, 5, limit=20).select("word", "other").collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in pool for b in pool if one_edit(a, b)}


def test_chains_of_forms_end_at_the_root(spark):
    pairs = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(30)], "word string, form string")
    got = {r["word"]: r["root"] for r in spelling.roots_of(pairs).collect()}
    assert got == {f"w{k}": "w30" for k in range(30)}


def test_spelling_awkward_rows(spark):
    docs = awkward(spark).unionByName(docs_of(spark, [(20, "Ahorn ahorn AHORN ahorns Ahorns ahorns " * 3), (21, "x" * 3000 + " ")] * 3, clashing=True))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert variants_of(spark, spelling.spelling_variants(docs, min_count=2)) == brute_variants(brute_words(rows, 5, 2, 97))
    assert spelling.spelling_variants(docs.limit(0)).count() == 0


# -- token files -------------------------------------------------------------


def test_packing_is_lossless():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 7, 239, 240, 241, 4000):
        for top in (1, 2, 3, 200, 2**15 - 1, 2**15, 50_257, 2**31, 2**60, 2**64 - 1):
            values = rng.integers(0, top, n, dtype=np.uint64, endpoint=False) if top > 1 else np.zeros(n, np.uint64)
            assert (token_files.unpack(*token_files.pack(values), n) == values).all()
    edges = np.array([2**64 - 1, 2**60 - 1, 2**60 - 2, 0, 1, 3] * 50, dtype=np.uint64)
    assert (token_files.unpack(*token_files.pack(edges), 300) == edges).all()


def test_large_values_are_escaped_and_do_not_widen_the_rest():
    values = np.full(3000, 17, dtype=np.uint64)
    plain = len(token_files.pack(values)[0])
    values[::500] = 2**40
    words, escapes = token_files.pack(values)
    assert len(escapes) == 6 and len(words) == plain and plain <= 3000 // 12


def brute_tokens(rows, end_id):
    library, out, start = tokenizers.Tokenizer.from_file(BPE), [], 0
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [end_id]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


ODD = ["don't  stop\x85\x1c a", "日本 語 123 ½ ²", "<|endoftext|> a # b", "a\n\n b\t\tc  ", "'s 're'll '", "é üİ​ z", "\n", "", None]


@pytest.mark.parametrize("block,file_ids,split", [(65_536, 256_000_000, 16_000_000), (7, 100, 30), (64, 50, 1)])
def test_files_equal_the_library(spark, tmp_path, monkeypatch, block, file_ids, split):
    monkeypatch.setattr(token_files, "BLOCK_IDS", block)
    monkeypatch.setattr(token_files, "FILE_IDS", file_ids)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, prose(i, 3 + 7 * i)) for i in range(25)] + [(-5, "first")]
    path = str(tmp_path / "out")
    token_files.write_tokens(docs_of(spark, rows[::-1], clashing=True), BPE, path, end_id=2, partitions=3)
    got = sorted((tuple(r) for r in token_files.read_tokens(spark, path, split).collect()), key=lambda r: r[0])
    assert got == brute_tokens(sorted(rows, key=lambda r: r[0]), 2)


def test_encoder_equals_the_library_on_odd_texts():
    rng, library = random.Random(5), tokenizers.Tokenizer.from_file(BPE)
    signs = ["a", "s", "t", "re", "ll", "'", "'", " ", " ", "\n", "\t", "\r", "1", ",", "é", "²", "\xad", "ɏ"]
    signs += ["\x00", "\x85", "\xa0", "日", "<|endoftext|>", "ɐ", "😀"]
    texts = ["".join(rng.choices(signs[: rng.choice((17, len(signs)))], k=rng.randrange(14))) for _ in range(4000)]
    encode = token_files.Encoder(open(BPE, encoding="utf-8").read())
    expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for size in (1, 5, 1000):
        got = [ids.tolist() for k in range(0, len(texts), size) for ids in encode(texts[k : k + size])]
        assert got == expected
    assert encode([]) == []


def test_known_pieces_cost_less_than_finding_them_one_by_one():
    texts = [prose(i, 3000, 300) for i in range(60)]
    encode = token_files.Encoder(open(BPE, encoding="utf-8").read())
    encode(texts)

    def seconds(work):
        def once():
            begin = time.process_time()
            work()
            return time.process_time() - begin

        return min(once() for _ in range(5))

    one_by_one = re.compile(r" ?[a-z]+| ?[0-9]+| ?[^\sa-z0-9]+|\s").findall
    assert seconds(lambda: encode(texts)) < seconds(lambda: [one_by_one(t) for t in texts])


def test_token_files_awkward_rows(spark, tmp_path):
    docs, path = awkward(spark), str(tmp_path / "out")
    token_files.write_tokens(docs, BPE, path, end_id=2)
    got = [tuple(r) for r in token_files.read_tokens(spark, path).orderBy("start").collect()]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted((str(r[0]), *r[2:]) for r in got) == sorted((str(r[0]), *r[2:]) for r in brute_tokens(rows, 2))
    assert [r[1] for r in got] == [sum(r[2] for r in got[:k]) for k in range(len(got))]
    ids = [r[0] for r in got]
    assert ids == sorted(ids, key=lambda i: (i is None, i or 0)) and ids.count(None) == 2
    empty = str(tmp_path / "empty")
    token_files.write_tokens(docs.limit(0), BPE, empty, end_id=2)
    assert token_files.read_tokens(spark, empty).count() == 0


def test_files_of_a_lost_attempt_do_not_count(spark, tmp_path):
    docs, path = docs_of(spark, [(i, f"text {i}") for i in range(20)]), str(tmp_path / "out")
    token_files.write_tokens(docs, BPE, path, end_id=2, partitions=2)
    stray = token_files._File(f"{path}/ids", 0, 0)
    stray.add(999, np.array([1, 2], dtype=np.uint64))
    stray.close()
    assert {r["doc_id"] for r in token_files.read_tokens(spark, path).collect()} == set(range(20))
