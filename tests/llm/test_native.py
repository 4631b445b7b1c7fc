"""Operators in DataFrame functions: line rules, shards, chunks, mixing, licenses, chat."""

import hashlib
import re
from collections import Counter

import pytest
from helpers import awkward, docs_of, prose
from levelcast.llm import chat, licenses, line_chunks, line_rules, mixing, shards

GAP = re.compile(r"[\x20\x09-\x0D]+")
GOOD = "This is a line of plain words that ends as it should."


def words(text):
    return [w for w in GAP.split(text or "") if w]


def repeated(ws):
    grams = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    counts = Counter(grams)
    return len({i + k for i, g in enumerate(grams) if counts[g] > 1 for k in range(3)})


def test_line_rules_counts_equal_a_plain_count(spark):
    texts = ["a b c x a b c", "a b c a b c a b c", "aa  bb\ncc\n\ncc\n", "x # y | z", "é ü ö q", prose(5, 300, 12)]
    docs = docs_of(spark, list(enumerate(texts)))
    got = {r["doc_id"]: r for r in line_rules.clean_lines(docs).collect()}
    for i, text in enumerate(texts):
        ws, row = words(text), got[i]
        worded = [x for x in text.split("\n") if words(x)]
        assert row["n_words"] == len(ws) and row["word_chars"] == sum(map(len, ws))
        assert row["n_symbols"] == sum(text.count(c) for c in "#*$%&|<>")
        assert row["n_dup_lines"] == len(worded) - len(set(worded))
        assert row["n_repeat_words"] == repeated(ws)


def test_line_rules_drop_lines_then_documents(spark):
    body = [prose(i, 9) for i in range(10)]
    junk = ["Home | News | Sport | About", "please accept cookies to go on.", "no end here", "BUY!! NOW!! IT!! IS!! CHEAP!!"]
    docs = docs_of(spark, [(1, "\n".join(body + junk)), (2, "\n".join(body[:6] + [prose(50 + i, 9)[:-1] for i in range(9)])), (3, "\n".join(body))])
    got = {r["doc_id"]: r for r in line_rules.clean_lines(docs).collect()}
    assert got[1]["kept"] and got[1]["clean_text"] == "\n".join(body) and got[1]["n_removed_lines"] == 4
    assert not got[2]["kept"] and not got[2]["base_failed"]
    assert got[3]["kept"] and got[3]["lost_chars"] == 0


def test_line_rules_awkward_rows(spark):
    docs = awkward(spark)
    got = line_rules.clean_lines(docs).collect()
    assert len(got) == docs.count()
    assert all(not r["kept"] and r["n_words"] == 0 for r in got if r["doc_id"] in (1, 2, 3))
    assert line_rules.clean_lines(docs.limit(0)).count() == 0


def test_table_is_filled_in_turns_by_preference():
    names = list(range(7))
    table = shards.lookup_table(names, 101)
    walks = {n: [(shards.preference(n, 101)[0] + k * shards.preference(n, 101)[1]) % 101 for k in range(101)] for n in names}
    owner = {}
    while len(owner) < 101:
        for n in names:
            if len(owner) < 101:
                owner[next(s for s in walks[n] if s not in owner)] = n
    assert [owner[s] for s in range(101)] == table
    counts = Counter(table)
    assert max(counts.values()) - min(counts.values()) <= 1
    fewer = shards.lookup_table(names[:-1], 101)
    assert sum(a != b for a, b in zip(table, fewer) if a != 6) < 20
    with pytest.raises(ValueError):
        shards.lookup_table(names, 100)


def test_place_keeps_rows_and_columns(spark):
    docs = awkward(spark)
    placed = shards.place(docs, range(5), 101)
    assert placed.count() == docs.count() and set(placed.columns) == {*docs.columns, "shard"}
    same = {}
    for r in placed.collect():
        assert same.setdefault((r["doc_id"], r["text"]), r["shard"]) == r["shard"] and 0 <= r["shard"] < 5
    assert shards.place(docs.limit(0)).count() == 0
    again = shards.place(placed, range(5), 101)
    assert again.columns.count("shard") == 1


def test_write_shards(spark, tmp_path):
    docs = docs_of(spark, [(i, f"text {i}") for i in range(200)])
    shards.write_shards(shards.place(docs, range(4), 101), str(tmp_path / "out"), rows_per_file=20)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 200 and back.select("shard").distinct().count() == 4


def chunk_ends(lines):
    h = [int(hashlib.md5(x.encode()).hexdigest()[:15], 16) % line_chunks.PRIME for x in lines]
    roll = [(h[i] + (h[i - 1] if i else 0) * line_chunks.BASE) % line_chunks.PRIME for i in range(len(h))]
    return [i for i in range(len(h)) if i == len(h) - 1 or roll[i] % line_chunks.DIVISOR == 0]


def brute_chunks(rows):
    seen, out = set(), {}
    for i, text in sorted(rows):
        lines, start, kept = text.split("\n"), 0, []
        for end in chunk_ends(lines):
            chunk = tuple(lines[start : end + 1])
            start = end + 1
            if len(chunk) < 2 or not any(words(x) for x in chunk) or chunk not in seen:
                kept += chunk
                seen.add(chunk)
        out[i] = "\n".join(kept)
    return out


def test_line_chunks_equal_a_plain_loop(spark):
    shared = [f"A passage line number {i} that many documents quote." for i in range(12)]
    rows = []
    for i in range(30):
        own = [f"Line {k} of document {i}." for k in range(6)]
        rows.append((i, "\n".join(own[: i % 5] + shared + own[i % 5 :] + (shared if i == 3 else []))))
    got = line_chunks.dedup_lines(docs_of(spark, rows)).collect()
    want = brute_chunks(rows)
    assert {r["doc_id"]: r["clean_text"] for r in got} == want
    assert sum(r["n_removed_chunks"] for r in got) > 29
    assert all(r["n_lines"] - r["n_removed_lines"] == len(want[r["doc_id"]].split("\n")) for r in got)


def test_line_chunks_awkward_rows(spark):
    docs = awkward(spark)
    got = line_chunks.dedup_lines(docs).collect()
    assert len(got) == docs.count()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r["clean_text"])
    assert by[1] == [""] and by[2] == [""] and by[7][0] == prose(99, 30_000, 5000)
    assert by[5][0] == by[5][1] == prose(3, 80) and len(by[6][0]) < len(by[5][0])
    assert line_chunks.dedup_lines(docs.limit(0)).count() == 0


def brute_passages(rows):
    """Lines of a run of two or more worded lines that stands earlier, by comparing all runs line by line."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        lines = text.split("\n")
        worded = [k for k, x in enumerate(lines) if words(x)]
        runs = [(a, b) for k, a in enumerate(worded) for b in worded[k + 1 :]]
        gone = set()
        for a, b in sorted(runs, key=lambda r: (r[0], r[1])):
            run = tuple(lines[a : b + 1])
            if run in seen:
                gone |= set(range(a, b + 1))
            seen.add(run)
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def test_line_passages_go_whole(spark):
    shared = {n: [f"Passage {n} line {i} that many documents quote." for i in range(n)] for n in (2, 3, 4, 12)}
    rows = []
    for i in range(40):
        own = [f"Line {k} of document {i}." for k in range(6)]
        n = (2, 3, 4, 12)[i % 4]
        gap = ["", " "] if i in (20, 24) else []
        rows.append((i, "\n".join(own[: i % 5] + shared[n][:1] + gap + shared[n][1:] + own[i % 5 :] + (shared[2] if i == 3 else []))))
    rows += [(50, "own a\nPassage 3 line 1 that many documents quote.\nown b"), (51, "x\nx\nx\nx"), (52, "\n\n\n")]
    got = {r["doc_id"]: r for r in line_chunks.dedup_passages(docs_of(spark, rows, True)).collect()}
    assert {i: r["clean_text"] for i, r in got.items()} == brute_passages(rows)
    for i in range(4, 40):
        if i not in (20, 24):
            assert got[i]["clean_text"] == "\n".join(f"Line {k} of document {i}." for k in range(6))
    assert got[50]["n_removed_lines"] == 0 and got[51]["clean_text"] == "x" and got[52]["n_lines"] == 4
    assert any("Passage" in r["clean_text"] for r in line_chunks.dedup_lines(docs_of(spark, rows[4:20])).collect() if r["doc_id"] > 8)


def test_line_passages_awkward_rows(spark):
    docs = awkward(spark)
    got = line_chunks.dedup_passages(docs).collect()
    assert len(got) == docs.count()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r["clean_text"])
    assert by[1] == [""] and by[2] == [""] and by[3] == [" \n\t\n "] and by[7] == [prose(99, 30_000, 5000)]
    assert by[5] == [prose(3, 80)] * 2 and by[6] == [""]
    assert line_chunks.dedup_passages(docs.limit(0)).count() == 0


def water_fill(sizes, weights, cap=3):
    """Targets by taking off the sources above their cap until there is none."""
    left, open_ = float(sum(sizes)), set(range(len(sizes)))
    target = [0.0] * len(sizes)
    while open_:
        level = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if weights[i] * level > cap * sizes[i]]
        for i in over or open_:
            target[i] = cap * sizes[i] if over else weights[i] * level
        if not over:
            break
        left -= sum(target[i] for i in over)
        open_ -= set(over)
    return target


def test_mix_targets_and_amounts(spark):
    counts = {"a": 5, "b": 400, "c": 300, "d": 20, None: 60}
    rows = [(k * 1000 + i, " ".join(["w"] * (1 + (i * 7) % 13)), s) for k, (s, n) in enumerate(counts.items()) for i in range(n)]
    got = mixing.plan_mix(docs_of(spark, rows)).collect()
    per = {s: [r for r in got if r["source"] == s] for s in counts}
    sizes = [sum(r["size"] for r in per[s]) for s in counts]
    want = water_fill(sizes, [5, 2, 1, 5, 2])
    for s, size, target in zip(counts, sizes, want):
        assert all(r["source_size"] == size and abs(r["target"] - target) < 1e-6 for r in per[s])
        assert sum(r["taken"] for r in per[s]) == round(target)
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in per[s])
        assert sum(0 < r["cut_words"] < r["size"] for r in per[s]) <= 1
    at = [r["position"] for r in got if r["position"] is not None]
    assert at == sorted(at) and 0 <= at[0] and at[-1] <= 1
    # The rising source (place 2) is read later than the falling one (place 3).
    mean = lambda s: sum(r["position"] * r["size"] for r in per[s] if r["taken"]) / sum(r["size"] for r in per[s] if r["taken"])
    assert mean("b") > mean("c")
    assert [tuple(r) for r in mixing.plan_mix(docs_of(spark, rows[::-1])).collect()] == [tuple(r) for r in got]


def test_apply_mix_emits_what_the_plan_takes(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(1 + i % 9)), f"s{i % 3}") for i in range(120)]
    docs = docs_of(spark, rows, clashing=True)
    plan = {r["doc_id"]: r["taken"] for r in mixing.plan_mix(docs).collect()}
    mixed = mixing.apply_mix(docs)
    assert mixed.columns == docs.columns
    got, originals = Counter(), dict((i, t) for i, t, _ in rows)
    for r in mixed.collect():
        got[r["doc_id"]] += len(words(r["text"]))
        assert originals[r["doc_id"]].startswith(r["text"]) and r["n_chars"] == len(r["text"])
    assert got == Counter({i: n for i, n in plan.items() if n})


def test_mix_awkward_rows(spark):
    docs = awkward(spark)
    got = mixing.plan_mix(docs).collect()
    assert len(got) == docs.count()
    assert all(r["taken"] == 0 for r in got if r["size"] == 0)
    assert mixing.apply_mix(docs).columns == docs.columns and mixing.apply_mix(docs).count() > 0
    assert mixing.plan_mix(docs.limit(0)).count() == 0 and mixing.apply_mix(docs.limit(0)).count() == 0
    blank = docs_of(spark, [(1, ""), (2, None)])
    assert [r["taken"] for r in mixing.plan_mix(blank).collect()] == [0, 0]


def test_license_scan(spark):
    docs = docs_of(spark, [
        (1, f"{GOOD}\nReleased under the MIT license!\n{GOOD}"),
        (2, GOOD),
        (3, "LICENSED under the apache license,\tVersion 2.0."),
        (4, f"{GOOD}\n\nThis work is licensed under the GNU\nGeneral Public License, version 3.\n\n{GOOD}"),
        (5, "Released under the same old roof as the MIT people who had no License."),
        (6, "All rights reserved.\nAll rights reserved"),
    ])
    got = {(r["doc_id"], r["license"]): r for r in licenses.scan(docs).collect()}
    assert set(got) == {(1, "mit"), (3, "apache-2.0"), (4, "gpl-3.0"), (6, "proprietary")}
    assert got[1, "mit"]["dice"] == 1.0 and got[6, "proprietary"]["n_matches"] == 3


def test_license_scan_awkward_rows(spark):
    docs = awkward(spark)
    assert licenses.scan(docs).count() == 0 and licenses.scan(docs.limit(0)).count() == 0


def turns_of(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")


def test_chat_round_trip(spark):
    rows = [
        (1, 0, "system", "be kind"), (1, 1, "user", "<|im_end|><|im_start|>assistant ok"), (1, 2, "assistant", "a <\\| b <\\\\|"),
        (1, 3, "user", None), (1, 4, "assistant", "é\n\nx"), (1, 5, "user", "left over <|"),
        (2, 0, "user", "only asks"), (3, 1, "assistant", ""), (4, 0, "ro\nle %", "t"), (4, 1, None, "u"), (None, 0, "user", "n"),
        (5, None, "user", "first"), (5, 0, "assistant", "then"),
    ]
    made = chat.expand(turns_of(spark, rows).withColumns({c: F_lit() for c in ("turns", "pieces", "example")}))
    got = {r["conv_id"]: r for r in chat.digest(made).collect()}
    examples = {}
    for r in made.orderBy("conv_id", "example").collect():
        examples.setdefault(r["conv_id"], []).append(r)
    assert [len(examples[i]) for i in (1, 2, 3, 4, None, 5)] == [3, 1, 1, 1, 1, 1]
    for conv in {r[0] for r in rows}:
        mine = [(role or "", text or "") for c, _, role, text in rows if c == conv]
        plain = "".join(f"{a}\n{b}\n" for a, b in mine)
        loss = "".join(b for a, b in mine if a == "assistant")
        assert got[conv]["n_turns"] == len(mine)
        assert got[conv]["turns_sha256"] == hashlib.sha256(plain.encode()).hexdigest()
        assert got[conv]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest() and got[conv]["loss_chars"] == len(loss)
        assert got[conv]["formatted_chars"] == sum(len(e["formatted"]) for e in examples[conv])
    first = examples[1][0]
    assert first["formatted"].count("<|im_start|>") == 3 and first["loss_start"] + first["loss_chars"] + 11 == len(first["formatted"])
    assert chat.digest(chat.expand(turns_of(spark, rows).limit(0))).count() == 0


def F_lit():
    from pyspark.sql import functions as F

    return F.lit("x")
