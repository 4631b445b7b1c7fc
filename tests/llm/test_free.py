"""Near duplicates, edit matching, toxicity, compression quality, the pipeline and the SQL checks."""

import itertools
import math
import random
import re
import sys
import time
import tracemalloc
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from helpers import awkward, docs_of, prose
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from levelcast.llm import compression_quality, decontaminate, line_rules, mixing, near_dup, queries, toxicity  # noqa: E402
from levelcast.llm.common import stable_hash  # noqa: E402

SF = "/root/testdata/sf0.001"


def sets_of(rows, width):
    made = {}
    for key, text in rows:
        ws = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "")) if w]
        ws = [w.translate({c: c + 32 for c in range(65, 91)}) for w in ws]
        made[key] = {tuple(ws[i : i + width]) for i in range(len(ws) - width + 1)} or ({tuple(ws)} if ws else set())
    return made


def brute_components(rows, width, percent):
    sets = sets_of(rows, width)
    lead = {k: k for k in sets}

    def root(k):
        while lead[k] != k:
            k = lead[k]
        return k

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and both * 100 >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            lead[y] = x
    return {k: root(k) for k in sets}


def edited(text, rng, share):
    return " ".join(w if rng.random() > share else f"z{rng.randrange(10**6)}" for w in text.split(" "))


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_near_duplicates_equal_all_pairs(spark, width, percent):
    rng, rows = random.Random(width), []
    passage = prose(77, 60)
    for g in range(12):
        base = prose(g, rng.choice((12, 40, 120, 400)))
        rows += [edited(base, rng, rng.choice((0.0, 0.01, 0.02, 0.04))) for _ in range(rng.choice((2, 5, 14)))]
    rows += [passage + "\n" + prose(1000 + i, rng.choice((10, 30, 80))) for i in range(25)]
    rows += ["a b", "A B", "a", "", "a b c"]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    got = near_dup.near_duplicates(docs_of(spark, rows), width, percent).collect()
    want, sets = brute_components(rows, width, percent), sets_of(rows, width)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == want[r["doc_id"]]) and r["n_shingles"] == len(sets[r["doc_id"]]) for r in got)
    assert all(r["kept"] == r["representative"] for r in got)


def test_members_that_are_not_linked_meet_once(spark, monkeypatch):
    """Variants of one text, none near enough to another: pair rows stay near the number of pairs."""
    rng, base, found = random.Random(5), prose(3, 300, 2000), {}
    rows = [(i, edited(base, rng, 0.035)) for i in range(60)]
    own = near_dup.mixed_pairs
    monkeypatch.setattr(near_dup, "mixed_pairs", lambda *a: found.setdefault("pairs", own(*a)))
    got = near_dup.near_duplicates(docs_of(spark, rows), 3, 85).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute_components(rows, 3, 85)
    pairs = found["pairs"]
    assert 0 < pairs.count() <= 3 * pairs.distinct().count()


def test_a_large_group_makes_few_pairs(spark):
    rng, base = random.Random(3), prose(5, 150)
    rows = [(i, edited(base, rng, 0.01)) for i in range(400)]
    classes = near_dup.near_duplicates(docs_of(spark, rows), 3, 85)
    assert classes.filter("kept").count() == len(set(brute_components(rows, 3, 85).values()))


def test_near_duplicates_awkward_rows(spark):
    docs = awkward(spark)
    got = near_dup.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    by = {(r["doc_id"], r["text_hash"]): r for r in got}
    assert all(r["component_id"] == 5 for r in got if r["doc_id"] in (5, 6))
    assert all(r["n_shingles"] == 0 and r["kept"] for (i, _), r in by.items() if i in (1, 2, 3))
    assert near_dup.near_duplicates(docs.limit(0)).count() == 0
    mixed = docs_of(spark, [(None, prose(4, 90)), (9, prose(4, 90)), (None, prose(6, 90))])
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in near_dup.near_duplicates(mixed).collect()) == [
        (0, 0, True), (0, 9, False), (9, 9, True)]


def test_sketch_bound():
    for k, percent in ((48, 85), (48, 80), (64, 90)):
        t, p = near_dup.least_shared(k, percent), percent / 100
        tail = lambda n: sum(math.comb(k, i) * p**i * (1 - p) ** (k - i) for i in range(n))
        assert tail(t) <= near_dup.MISS < tail(t + 1)


def edit_distance_anywhere(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != c), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_bit_parallel_distance():
    rng = random.Random(1)
    for _ in range(200):
        pattern = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 90)))
        text = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 120)))
        if rng.random() < 0.5:
            at = rng.randrange(len(text) + 1)
            text = text[:at] + pattern[: rng.randrange(len(pattern) + 1)] + text[at:]
        want, limit = edit_distance_anywhere(pattern, text), rng.randrange(0, 30)
        got = decontaminate.best_match(decontaminate.bits_of(pattern), len(pattern), text, limit)
        assert (got[0] if got else None) == (want if want <= limit else None)


def damage(text, rng, edits):
    chars = list(text)
    for _ in range(edits):
        at, kind = rng.randrange(len(chars)), rng.randrange(3)
        chars[at : at + (kind != 0)] = [rng.choice("xyz")] if kind < 2 else []
    return "".join(chars)


def test_contamination_equals_brute_force(spark):
    rng = random.Random(2)
    items = [(i, prose(500 + i, 30)) for i in range(12)] + [(50, "short item text"), (51, None), (52, "  ")]
    rows = []
    for i in range(60):
        text = prose(i, 120)
        if i % 3 == 0:
            item = rng.choice(items[:12])[1]
            at = rng.randrange(len(text))
            text = text[:at] + " " + damage(item, rng, rng.choice((0, 3, 8, 12, 25))) + " " + text[at:]
        if i == 7:
            text += " SHORT   item\ttext"
        if i == 8:
            text += " short item texts"
        rows.append((i, text))
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(1))
    want = {}
    for i, text in rows:
        for k, item in items[:12]:
            pattern = decontaminate.normalise(item)
            d = edit_distance_anywhere(pattern, decontaminate.normalise(text)) if i % 3 == 0 else len(pattern)
            if d <= decontaminate.budget(len(pattern)):
                want[i, k] = d
    want[7, 50] = 0
    for block_chars in (decontaminate.BLOCK_CHARS, 700):
        got = decontaminate.contamination(docs_of(spark, rows, True), bench, block_chars=block_chars).collect()
        assert {(r["doc_id"], r["item_id"]): r["distance"] for r in got} == want
        clean = decontaminate.decontaminate(docs_of(spark, rows, True), bench, block_chars=block_chars)
        assert {r["doc_id"] for r in clean.collect()} == {i for i, _ in rows} - {i for i, _ in want}
    assert len(want) > 8


def test_short_items_next_to_punctuation(spark):
    bench = spark.createDataFrame([(1, "What is 2+2?"), (2, "name the capital"), (3, "(a) or b")], "item_id bigint, text string")
    texts = ["(What is 2+2?)", '"what is 2+2?", he asked', "Name the capital, please.", "\u201cname the capital\u201d", "x:(a) or b;",
             "name the capitals", "rename the capital", "name the capital\u0301", "so what is 2+2?", "name_the capital", "(a) or both"]
    got = decontaminate.contamination(docs_of(spark, list(enumerate(texts))), bench).collect()
    assert {(r["doc_id"], r["item_id"], r["distance"]) for r in got} == {(0, 1, 0), (1, 1, 0), (2, 2, 0), (3, 2, 0), (4, 3, 0), (8, 1, 0)}
    assert all(decontaminate.normalise(texts[r["doc_id"]])[r["match_start"] : r["match_end"]] in ("what is 2+2?", "name the capital", "(a) or b") for r in got)


def test_contamination_awkward_rows(spark):
    docs = awkward(spark)
    bench = spark.createDataFrame([(1, prose(3, 80))], "item_id bigint, text string")
    got = decontaminate.contamination(docs, bench).collect()
    assert sorted(r["doc_id"] for r in got) == [5, 5, 6]
    assert decontaminate.contamination(docs, bench.limit(0)).count() == 0
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == docs.count()
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0


def test_block_max_search_is_exact():
    rng = random.Random(4)
    vocabulary = [f"t{i}" for i in range(60)]
    bags = [Counter(rng.choices(vocabulary, k=rng.randrange(0, 12))) for _ in range(500)]
    index = toxicity.BlockMaxIndex(vocabulary, bags, list(range(500)), [i % 2 for i in range(500)])
    vectors = {i: dict(zip(*map(list, index.vector(bags[i])))) for i in range(500)}
    for _ in range(60):
        query = Counter(rng.choices(vocabulary, k=rng.randrange(1, 10)))
        q = dict(zip(*map(list, index.vector(query))))
        want = sorted((sum(w * v.get(t, 0.0) for t, w in q.items()) for v in vectors.values()), reverse=True)[:15]
        got = index.nearest(query)
        assert [round(s, 9) for s, _ in got] == [round(s, 9) for s in want if s > 0]


def test_block_bounds_hold_and_close_texts():
    """No cosine exceeds its bound; most texts of other themes stay closed; terms read word by word are the terms."""
    texts = [prose(i, 40).replace("w", f"theme{i % 8}x") + " the of and" for i in range(400)]
    bags = [toxicity.terms(t) for t in texts]
    vocabulary = sorted(set().union(*bags))
    index = toxicity.BlockMaxIndex(vocabulary, bags, list(range(400)), [0] * 400, block=8, long=16)
    assert index.dense.shape[1] >= 3
    reader = toxicity.TermReader(index.vocabulary, memory=100)
    vectors = [dict(zip(*map(list, index.vector(b)))) for b in bags]
    for at in range(0, 400, 10):
        numbers, counts = reader.read(texts[at] + " unheard unheardof")
        bag = toxicity.terms(texts[at] + " unheard unheardof")
        assert sorted(counts) == sorted(bag.values()) and len(numbers) == len(bag)
        query = index.weigh(numbers, counts)
        q = dict(zip(*map(list, query)))
        cosines = np.array([sum(w * v.get(t, 0.0) for t, w in q.items()) for v in vectors])
        bound = index.bounds(*query)[2].ravel()
        assert (cosines <= bound[index.slot] + 1e-9).all()
        found = index.search(*query)
        assert [s for s, _ in found] == pytest.approx(sorted(cosines, reverse=True)[:15])
        others = index.search(*query, leave_out=at)
        assert at not in [p for _, p in others] and others[:14] == [x for x in found if x[1] != at][:14]
    assert index.opened < 80 * 400 / 2


def test_terms_of_many_texts_are_the_terms():
    rng, signs = random.Random(4), list("abcdefgh") + ["some", "Thing", "_", " ", ".", "é", "Ä", "İ", "Σ", "ΑΣ", "日本", "½", "٣", "\0", "😀", "ǅ"]
    texts = ["".join(rng.choices(signs, k=rng.randrange(40))) for _ in range(600)] + ["", "..."]
    bags = [toxicity.terms(t) for t in texts]
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*bags[:200])))}
    for memory in (1, 500, 10**6):
        found = list(toxicity.TermReader(vocabulary, memory).read_all(texts))
        assert len(found) == len(texts)
        for bag, (numbers, counts) in zip(bags, found):
            known = numbers < len(vocabulary)
            assert dict(zip(numbers[known], counts[known])) == {vocabulary[t]: n for t, n in bag.items() if t in vocabulary}
            assert sorted(counts[~known]) == sorted(n for t, n in bag.items() if t not in vocabulary)
    assert list(toxicity.TermReader({}).read_all([])) == [] and len(toxicity.TermReader({}).read("a")[0]) == 1


def test_terms_in_arrays_cost_less_than_word_by_word():
    texts = [prose(i, 500, 10**5) for i in range(300)]
    reader = toxicity.TermReader({t: i for i, t in enumerate(sorted(set().union(*map(toxicity.terms, texts[:60]))))})

    def seconds(work):
        begin = time.process_time()
        work()
        return time.process_time() - begin

    together = min(seconds(lambda: list(reader.read_all(texts))) for _ in range(3))
    assert together < 0.8 * min(seconds(lambda: [toxicity.terms(t) for t in texts]) for _ in range(3))


def test_search_uses_its_memory_again():
    """The second search makes no array of the size of the lists it adds up."""
    bags = [Counter(f"t{i * k % 997}" for k in range(1, 121)) for i in range(1, 2001)]
    index = toxicity.BlockMaxIndex(sorted(set().union(*bags)), bags, list(range(2000)), [0] * 2000)
    query = Counter(f"t{i}" for i in range(1, 997))
    first = index.nearest(query)
    entries = int(np.diff(index.starts).sum())
    tracemalloc.start()
    try:
        assert index.nearest(query) == first
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert entries > 100_000 and peak < 20 * entries
    assert toxicity.BlockMaxIndex.__getstate__(index)["held"] == {}


def test_neighbours_by_all_terms(spark):
    """A text without any word that goes with the label still finds its near copy, by the plain cosine."""
    rude = [(100 + i, prose(i, 60) + (" you fool" if i % 2 else " dear friend")) for i in range(60)]
    rare = [(900, prose(900, 60, 10**6)), (901, prose(900, 60, 10**6) + " w1 unheard")]
    docs = docs_of(spark, rude + rare)
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rude] + [(900, 0)], "doc_id bigint, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, labels, lambda i: F.lit(True)).collect()}
    near = got[901]["neighbours"][0]
    assert near["doc_id"] == 900 and 0.9 < near["cosine"] < 1 and got[901]["score"] < 0.5
    assert got[900]["neighbours"][0]["cosine"] == pytest.approx(1.0)
    sample = [(i, t, int(i) % 2) for i, t in rude] + [(900, rare[0][1], 0)]
    (index, _, _), _ = toxicity.fit(sample, {0: 31, 1: 30})
    vectors = [dict(zip(*map(list, index.vector(toxicity.terms(t))))) for _, t, _ in sample]
    assert all(len(v) == len(toxicity.terms(t)) for v, (_, t, _) in zip(vectors, sample))
    q = dict(zip(*map(list, index.vector(toxicity.terms(rare[1][1])))))
    want = sorted((sum(w * v.get(t, 0.0) for t, w in q.items()) for v in vectors), reverse=True)[:15]
    assert [s for s, _ in index.nearest(toxicity.terms(rare[1][1]))] == pytest.approx([s for s in want if s > 0])


@pytest.mark.parametrize("target", ["toxic", "quality"])
def test_classifiers_on_held_out_rows(spark, target):
    sf = "/root/testdata/sf0.01"
    name = {"toxic": "op2_nearest_toxic", "quality": "op3_compression_quality"}[target]
    scored = queries.queries()[name](spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = scored.filter("held_out").join(labels, "doc_id").collect()
    right = sum(r["predicted"] == r[target] for r in rows)
    assert right >= 0.9 * len(rows) and all(0 <= r["score"] <= 1 for r in rows)
    pos = [r["score"] for r in rows if r[target] == 1]
    neg = [r["score"] for r in rows if r[target] == 0]
    assert sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) >= 0.85 * len(pos) * len(neg)


def test_classifiers_awkward_rows(spark):
    docs = awkward(spark)
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    some = spark.createDataFrame([(4, 1, 0), (5, 0, 1), (None, 1, 1), (7, None, None), (77, 1, 0)], none.schema)
    rude = [(100 + i, prose(i, 60) + (" you fool" if i % 2 else " dear friend")) for i in range(60)]
    enough = spark.createDataFrame([(i, i % 2, i % 2) for i, _ in rude], none.schema)
    for labels, more in ((none, []), (some, []), (enough, rude)):
        table = docs.unionByName(docs_of(spark, more, True))
        for score in (toxicity.score_toxicity, compression_quality.score_quality):
            got = score(table, labels, lambda i: F.lit(True)).collect()
            assert len(got) == docs.count() + len(more) and all(0 <= r["score"] <= 1 for r in got)
            assert score(table.limit(0), labels, lambda i: F.lit(True)).count() == 0
    toxic = {r["doc_id"]: r for r in toxicity.score_toxicity(table, enough, lambda i: F.lit(True)).collect()}
    assert toxic[101]["score"] > 0.7 > 0.3 > toxic[100]["score"] and toxic[101]["neighbours"]


def test_pipeline_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = {r["doc_id"]: r for r in line_rules.clean_lines(docs).filter("kept").collect()}
    lead = brute_components([(i, r["clean_text"]) for i, r in rows.items()], 5, 80)
    stay = {i: r["clean_text"] for i, r in rows.items() if lead[i] == i}
    patterns = [decontaminate.normalise(b) for b in bench]
    clean = {}
    for i, text in stay.items():
        text_n = decontaminate.normalise(text)
        # Exact occurrence here; edited ones are covered by the brute-force test above.
        if not any(p in text_n for p in patterns):
            clean[i] = text
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in got} <= set(clean)
    left = docs_of(spark, [(i, t, "x") for i, t in clean.items()]).drop("source").join(docs.select("doc_id", "source"), "doc_id")
    found = {r["doc_id"] for r in decontaminate.contamination(left, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    plan = {r["doc_id"]: r for r in mixing.plan_mix(left.filter(~F.col("doc_id").isin(list(found) or [-1]))).collect()}
    taken = Counter()
    for r in got:
        taken[r["doc_id"]] += len(r["text"].split())
        assert clean[r["doc_id"]].startswith(r["text"]) and r["n_chars"] == len(r["text"])
    assert taken == Counter({i: r["taken"] for i, r in plan.items() if r["taken"]})
    assert set(got[0].asDict()) == {*docs.columns, "shard"}


def test_pipeline_stages_awkward_rows(spark):
    docs = awkward(spark)
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, SF)
        assert made.columns == docs.columns or name == "sharding"
        assert stage(spark, docs.limit(0), SF).count() == 0 and made.count() >= 0
    near = corpus_pipeline.near_dedup(spark, docs, SF).collect()
    assert sorted(r["doc_id"] for r in near if r["doc_id"]) == [1, 2, 3, 4, 5, 7, 8, 9]


def test_stable_hash(spark):
    row = spark.range(1).select(stable_hash(F.lit(12)).alias("a"), stable_hash(F.lit(None)).alias("b")).first()
    import hashlib

    assert row["a"] == int(hashlib.md5(b"12").hexdigest()[:15], 16) and row["b"] == int(hashlib.md5(b"").hexdigest()[:15], 16)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_agrees(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    want = con.sql(queries.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = sorted(df.columns)
    got = sorted(tuple(str(r[c]) for c in order) for r in df.collect())
    place = [want.columns.index(c) for c in order]
    assert got == sorted(tuple(str(r[i]) for i in place) for r in want.fetchall())
