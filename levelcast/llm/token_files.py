"""Token-id files in Simple-8b words, written and read by Spark tasks.

A file holds documents in order as blocks of at most `BLOCK_IDS` ids, followed by
a table of the blocks (places in the file, documents, ids) and its length, so a
reader can begin at any block. A block holds its documents' ids, lengths and
NULL marks and the token ids of all of them in 64-bit words.

A word has a 4-bit selector and 60 bits. Selectors 0 and 1 stand for 240 and 120
zeros, the others for a count of values of one width. In each width the largest
code is an escape: the value itself follows in a list of its own. A block takes
the width beyond which values are escaped by the size that results, so a few
large values do not widen the rest. Decoding takes all words of a selector at once.

Every task writes files of a name of its own and hands on a row about each; only
files in that table, written by Spark once all tasks are done, belong to the
result. So a task that is tried again, or twice, adds nothing.
"""

import json
import os
import re
import struct
import sys
import types
import unicodedata
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Window, functions as F

BLOCK_IDS = 65_536
MAGIC = b"LCTOKS8B"
FILE_IDS = 256_000_000  # a task begins another file beyond this
# Fixed values of the coding: how many values a word holds by selector, and their width.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
ESCAPE_BEYOND = (5, 8, 12, 15, 20, 30, 60)  # widths that a block may take as its last
FILES = "part int, at bigint, file string, docs bigint, ids bigint, bytes bigint"
ROWS = "part int, at bigint, doc_id bigint, before bigint, n_tokens bigint, ids_crc32 bigint"


# -- coding ------------------------------------------------------------------


def _least_width(values):
    """Least width whose codes hold a value; the largest code of a width is its escape, so it is not a value."""
    limits = np.array([(1 << int(w)) - 1 for w in WIDTHS[2:]], dtype=np.uint64)
    place = np.searchsorted(limits, values, side="right")
    return np.where(values == 0, 0, WIDTHS[2:][np.minimum(place, len(limits) - 1)]).astype(np.int8)


_SMALL = _least_width(np.arange(1 << 16, dtype=np.uint64))


def _all_of(good, count):
    """Whether all of the `count` places from each place on are good."""
    out, width = good, 1  # `out` is about runs of `width` places
    while width < count:
        step = min(width, count - width)
        out = out[:-step] & out[step:]
        width += step
    return out


def _pack(values, widest, least=None):
    """Words and escaped values of a uint64 array; values that `widest` bits cannot hold are escaped."""
    n = len(values)
    least = _widths(values) if least is None else least
    escaped = values >= np.uint64((1 << int(widest)) - 1)
    least = np.where(escaped, np.int8(widest), least)
    # From each place, how many values the best selector takes; beyond the end anything fits.
    selector = np.zeros(n, dtype=np.int8)
    for s in range(len(COUNTS) - 1, -1, -1):
        count = min(int(COUNTS[s]), n)
        small = least <= np.int8(WIDTHS[s])
        if WIDTHS[s] > widest or (WIDTHS[s] < widest and np.count_nonzero(small) < max(count, n // 16)):
            continue  # too rare to be worth a look
        good = _all_of(np.concatenate([small, np.full(count - 1, bool(WIDTHS[s]))]), count)
        np.copyto(selector, np.int8(s), where=good)
    step, starts, at = (np.arange(n, dtype=np.int32) + COUNTS.astype(np.int32)[selector]).tolist(), [], 0
    begin = starts.append
    while at < n:
        begin(at)
        at = step[at]
    starts = np.array(starts, dtype=np.int64)
    chosen = selector[starts].astype(np.int64)
    words = chosen.astype(np.uint64) << np.uint64(60)
    # Only words of the last width hold escapes: their code is its largest one.
    codes = np.concatenate([np.where(escaped, np.uint64((1 << int(widest)) - 1), values), np.zeros(240, np.uint64)])
    for s in np.flatnonzero(np.bincount(chosen)):
        if not WIDTHS[s]:
            continue
        of = np.flatnonzero(chosen == s)
        places, held = starts[of], words[of]
        for k in range(COUNTS[s]):
            held |= codes[places + k] << np.uint64(k * WIDTHS[s])
        words[of] = held
    return words, values[escaped]


def _widths(values):
    return _SMALL[values] if values.max() < len(_SMALL) else _least_width(values)


def pack(values):
    """(words, escapes) of unsigned 64-bit values, by the last width that is likely to make them smallest."""
    values = np.asarray(values, dtype=np.uint64)
    if not len(values):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    least = _widths(values)
    # Of four neighbours the widest sets the width, more or less; the coding is exact whatever is taken.
    each = np.bincount(least, minlength=61)
    fours = np.bincount(least[: len(least) // 4 * 4].reshape(-1, 4).max(axis=1), minlength=61)
    share = np.zeros(61)
    share[WIDTHS[::-1]] = 4 / COUNTS[::-1]
    sizes = {w: (fours[: w + 1] * share[: w + 1]).sum() + fours[w + 1 :].sum() * share[w] + each[w + 1 :].sum() for w in ESCAPE_BEYOND}
    return _pack(values, min(sizes, key=sizes.get), least)


def unpack(words, escapes, n):
    """The first n values of packed words."""
    words = np.asarray(words, dtype=np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selector]
    first = np.cumsum(counts) - counts
    values = np.zeros(int(counts.sum()), np.uint64)
    escaped = np.zeros(len(values), bool)
    for s in np.unique(selector):
        if not WIDTHS[s]:
            continue
        of = np.flatnonzero(selector == s)
        mask = np.uint64((1 << int(WIDTHS[s])) - 1)
        code = (words[of][:, None] >> (np.arange(COUNTS[s]) * WIDTHS[s]).astype(np.uint64)) & mask
        places = first[of][:, None] + np.arange(COUNTS[s])
        values[places] = code
        escaped[places] = code == mask
    values[np.flatnonzero(escaped)] = escapes
    return values[:n]


# -- files -------------------------------------------------------------------

# A block: documents that begin in it, documents in it, token ids, words and escapes of the
# lengths and of the ids; then doc_ids, NULL marks, lengths, ids.
_HEAD = "<7q"


def _block(docs, starts_here):
    """Bytes of a block of (doc_id, ids); `starts_here` is False if its first document began before."""
    lengths = np.array([len(ids) for _, ids in docs], dtype=np.uint64)
    ids = np.concatenate([ids for _, ids in docs])
    parts = [*pack(lengths), *pack(ids)]
    head = struct.pack(_HEAD, int(starts_here), len(docs), len(ids), *map(len, parts))
    names = np.array([0 if i is None else i for i, _ in docs], dtype="<i8")
    absent = np.array([i is None for i, _ in docs], dtype=np.uint8)
    return b"".join([head, names.tobytes(), absent.tobytes(), *[p.astype("<u8").tobytes() for p in parts]])


def _read_block(data):
    """(starts_here, doc_ids, lengths, ids) of the bytes of a block."""
    starts_here, n_docs, n_ids, *sizes = struct.unpack_from(_HEAD, data)
    at = struct.calcsize(_HEAD)
    take = lambda dtype, n: np.frombuffer(data, dtype, n, at)
    names = take("<i8", n_docs)
    at += names.nbytes
    absent = take(np.uint8, n_docs)
    at += absent.nbytes
    parts = []
    for size in sizes:
        parts.append(take("<u8", size))
        at += parts[-1].nbytes
    names = [None if a else int(i) for i, a in zip(names, absent)]
    return bool(starts_here), names, unpack(parts[0], parts[1], n_docs).astype(np.int64), unpack(parts[2], parts[3], n_ids)


class _File:
    """One file being written: blocks as they fill, then their table."""

    def __init__(self, folder, part, at):
        self.store, base = fs.FileSystem.from_uri(folder)
        self.store.create_dir(base, recursive=True)
        self.part, self.at, self.name = part, at, f"part-{part:05d}-{at}-{uuid.uuid4().hex}.tok"
        self.out = self.store.open_output_stream(f"{base}/{self.name}")
        self.out.write(MAGIC)
        self.place, self.table, self.docs, self.ids = len(MAGIC), [], 0, 0
        self.held, self.size, self.begins = [], 0, True

    def add(self, doc_id, ids):
        """A document; one that is longer than the rest of the block goes on in the next."""
        self.docs += 1
        while True:
            room = BLOCK_IDS - self.size
            self.held.append((doc_id, ids[:room]))
            self.size += min(len(ids), room)
            ids = ids[room:]
            if self.size >= BLOCK_IDS:
                self.flush(begins=not len(ids))
            if not len(ids):
                return

    def flush(self, begins=True):
        if self.held:
            data = _block(self.held, self.begins)
            self.table.append((self.place, len(data), int(self.begins), self.ids))
            self.out.write(data)
            self.place += len(data)
            self.ids += self.size
        self.held, self.size, self.begins = [], 0, begins

    def close(self):
        """Ends the file; the row about it."""
        self.flush()
        table = np.array(self.table, dtype="<i8").reshape(-1, 4)
        self.out.write(table.tobytes() + struct.pack("<q", len(table)) + MAGIC)
        self.out.close()
        return self.part, self.at, self.name, self.docs, self.ids, self.place


# -- tokens ------------------------------------------------------------------

# Characters below U+0250, on whose kinds all Unicode tables agree; the separators of ASCII and U+0085, U+00A0 are out.
PLAIN = "\t\n\r -~¡-ɏ"
ODD, END, SPACE, LETTER, NUMBER, MARK = range(6)  # kinds of characters; END stands between texts
SHORT, LONG = (b"s", b"t", b"m", b"d"), (b"re", b"ve", b"ll")  # what makes one piece with an apostrophe before it


def _kinds():
    """Kinds of all characters that take one or two of the bytes below 0xCA in UTF-8."""
    plain = re.compile(f"[{PLAIN}]")
    kind = lambda c: SPACE if c.isspace() else {"L": LETTER, "N": NUMBER}.get(unicodedata.category(c)[0], MARK)
    return np.array([kind(chr(c)) if plain.match(chr(c)) else ODD for c in range(0x280)], dtype=np.uint8)


class Pieces:
    """How byte-level tokenizers split texts into pieces: words, numbers, marks, white space.

    A space belongs to what follows it; white space before that is a piece of its own.
    All texts of a batch are split at once, as an array of bytes.
    """

    def __init__(self):
        self.kinds = _kinds()
        self.of_byte = np.full(256, ODD, dtype=np.uint8)
        self.of_byte[:128] = self.kinds[:128]

    def read(self, encoded):
        """(bytes of all texts, an END after each; their kinds; places of the ENDs)."""
        data = np.frombuffer(b"\0".join([*encoded, b""]), dtype=np.uint8)
        ends = np.cumsum(np.fromiter(map(len, encoded), np.int64, len(encoded)) + 1) - 1
        kinds = self.of_byte[data]
        two = np.flatnonzero((data >= 0xC2) & (data <= 0xC9))
        if len(two):
            points = (data[two].astype(np.int64) & 0x1F) << 6 | data[two + 1] & 0x3F
            kinds[two] = kinds[two + 1] = self.kinds[points]
        kinds[ends] = END
        return data, kinds, ends

    def starts(self, data, kinds, ends):
        """Places at which a piece begins; every END is a piece. No kind may be ODD."""
        begins = np.ones(len(data), dtype=bool)
        np.not_equal(kinds[1:], kinds[:-1], out=begins[1:])
        begins[ends] = True
        space = kinds == SPACE
        last = np.flatnonzero(space[:-1] & ~space[1:] & (kinds[1:] != END))
        begins[last] = True
        begins[last + 1] = data[last] != ord(" ")
        quote = np.flatnonzero(data == ord("'"))
        quote = quote[begins[quote] & (kinds[quote + 1] == LETTER)]
        first, second = data[quote + 1], data[quote + 2]  # an END follows at least
        for suffix in SHORT + LONG:
            found = quote[(first == suffix[0]) & (second == suffix[1] if len(suffix) > 1 else True)]
            begins[found + 1] = False
            begins[found + 1 + len(suffix)] = True
        return np.flatnonzero(begins)

    def split(self, data, kinds, ends):
        """(the piece numbers of all texts in order, the distinct pieces, how many pieces there are to each END)."""
        starts = self.starts(data, kinds, ends)
        bounds = pa.py_buffer(np.append(starts, len(data)))
        found = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, bounds, pa.py_buffer(data)]).dictionary_encode()
        return found.indices.to_numpy(), found.dictionary.to_pylist(), np.searchsorted(starts, ends)


PIECES = 1_000_000  # pieces whose ids a worker remembers


class Encoder:
    """Token ids by the tokenizers library, which is asked once for every distinct piece of text.

    The ids of a byte-level tokenizer's piece do not depend on what is around it.
    Other tokenizers, texts that hold one of the tokenizer's own tokens and texts
    in other scripts are encoded whole.
    """

    def __init__(self, spec):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the other cores have tasks of their own
        import tokenizers

        self.tokenizer = tokenizers.Tokenizer.from_str(spec)
        plan = json.loads(spec)
        split = plan.get("pre_tokenizer") or {}
        self.by_piece = (
            split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
            and not plan.get("normalizer") and not plan.get("post_processor") and not plan.get("truncation") and not plan.get("padding")
        )
        self.own = [t["content"] for t in plan.get("added_tokens", [])]
        self.pieces = Pieces()
        self.known = {b"\0": b""}  # END has no ids

    def __call__(self, texts):
        """One array of ids per text."""
        ask = lambda given: [np.array(e.ids, np.uint32).tobytes() for e in self.tokenizer.encode_batch_fast(given, add_special_tokens=False)]
        if not self.by_piece:
            return [np.frombuffer(x, np.uint32) for x in ask(texts)]
        encoded = [t.encode() for t in texts]
        data, kinds, ends = self.pieces.read(encoded)
        odd = {k for k, t in enumerate(texts) if any(o in t for o in self.own)}
        odd |= set(np.searchsorted(ends, np.flatnonzero(kinds == ODD)).tolist())
        if odd:
            data, kinds, ends = self.pieces.read([t for k, t in enumerate(encoded) if k not in odd])
        plain = self._by_piece(data, kinds, ends, ask) if len(ends) else iter(())
        whole = iter([np.frombuffer(x, np.uint32) for x in ask([texts[k] for k in sorted(odd)])])
        return [next(whole if k in odd else plain) for k in range(len(texts))]

    def _by_piece(self, data, kinds, ends, ask):
        numbers, distinct, stops = self.pieces.split(data, kinds, ends)
        if len(self.known) > PIECES:
            self.known = {b"\0": b""}
        new = [p for p in distinct if p not in self.known]
        self.known.update(zip(new, ask([p.decode() for p in new])))
        held = [self.known[p] for p in distinct]
        flat, sizes = np.frombuffer(b"".join(held), np.uint32), np.fromiter(map(len, held), np.int64, len(held)) // 4
        counts = sizes[numbers]
        before = np.cumsum(counts) - counts
        ids = flat[np.repeat((np.cumsum(sizes) - sizes)[numbers] - before, counts) + np.arange(int(counts.sum()))]
        return iter(np.split(ids, before[stops])[:-1])


def _encoder(spec):
    """The worker's encoder: tasks of one worker share what it remembers."""
    held = sys.modules.setdefault("_levelcast_encoders", types.ModuleType("_levelcast_encoders")).__dict__
    key = zlib.crc32(spec.encode()), len(spec)
    if key not in held:
        held[key] = Encoder(spec)
    return held[key]


def _writer(spec, folder, end_id, batch_chars):
    def write(batches):
        encode, file, done, at = _encoder(spec), None, [], 0
        for batch in batches:
            parts, ids, texts = (batch.column(i).to_pylist() for i in range(3))
            k = 0
            while k < len(texts):
                size, stop = 0, k
                while stop < len(texts) and (stop == k or size + len(texts[stop]) <= batch_chars):
                    size += len(texts[stop])
                    stop += 1
                for doc_id, tokens in zip(ids[k:stop], encode(texts[k:stop])):
                    if file is None:
                        file = _File(folder, parts[k], at)
                    file.add(doc_id, np.append(tokens, np.uint32(end_id)).astype(np.uint64))
                    if file.ids >= FILE_IDS:
                        done.append(file.close())
                        file, at = None, at + 1
                k = stop
        if file is not None:
            done.append(file.close())
        names = [x.split()[0] for x in FILES.split(", ")]
        kinds = (pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], names)

    return write


def write_tokens(docs, tokenizer, path, end_id, partitions=None, batch_chars=4_000_000):
    """Encode every text and write the token ids below `path`, in ascending doc_id order.

    `tokenizer` is the path, on the driver, of a file of the tokenizers library; `end_id`
    follows the ids of every document. Files of one document order are dealt by
    range: `partitions`, or the session's shuffle partitions. Rows without an id
    come last; rows of one id by a hash of the text, and repeated rows, which no
    order tells apart, as they come: both are dealt over several files when they
    are many. NULL texts are empty (the end id alone). An empty table writes an
    empty table of files. Other columns are ignored. A text is encoded whole; its
    ids go on in further blocks beyond `BLOCK_IDS`.
    """
    with open(tokenizer, encoding="utf-8") as f:
        spec = f.read()
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"h": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    order = [F.col("doc_id").asc_nulls_last(), F.col("h"), F.col("row")]
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    dealt = dealt.select(F.spark_partition_id().alias("part"), "doc_id", "text")
    files = dealt.mapInArrow(_writer(spec, f"{path}/ids", end_id, batch_chars), FILES)
    files.write.parquet(f"{path}/files")


def files_of(spark, path):
    """The table of files, with the documents and ids of all files before each.

    One row per file: the running totals are over that small table.
    """
    order = Window.orderBy("part", "at").rowsBetween(Window.unboundedPreceding, -1)
    files = spark.read.schema(FILES).parquet(f"{path}/files")
    return files.withColumn("ids_before", F.coalesce(F.sum("ids").over(order), F.lit(0)))


def _reader(folder):
    def blocks_of(file):
        size = file.size()
        tail = len(MAGIC) + 8
        file.seek(size - tail)
        n, mark = struct.unpack("<q8s", file.read(tail))
        file.seek(0)
        if mark != MAGIC or file.read(len(MAGIC)) != MAGIC:
            raise ValueError("not a token file")
        file.seek(size - tail - n * 32)
        return np.frombuffer(file.read(n * 32), "<i8").reshape(-1, 4)

    def read(batches):
        """Rows about documents: (part, at, doc_id, ids before it in the file, ids, their crc32)."""
        for batch in batches:
            store, base = fs.FileSystem.from_uri(folder)
            for part, at, name, first, last in zip(*(batch.column(i).to_pylist() for i in range(5))):
                with store.open_input_file(f"{base}/{name}") as file:
                    table, rows, open_doc = blocks_of(file), [], None
                    for place, size, begins, before in table.tolist():
                        # A split has the documents that begin in its range of ids, to their ends.
                        if begins and before >= last:
                            break
                        if (begins and before < first) or (not begins and open_doc is None):
                            open_doc = None
                            continue
                        file.seek(place)
                        starts_here, names, lengths, ids = _read_block(file.read(size))
                        data, bounds = ids.astype("<u4"), np.concatenate([[0], np.cumsum(lengths)]).tolist()
                        for k, (doc_id, lo, hi) in enumerate(zip(names, bounds, bounds[1:])):
                            piece = data[lo:hi].tobytes()
                            if k or starts_here:
                                open_doc = [part, at, doc_id, before + lo, 0, 0]
                                rows.append(open_doc)
                            open_doc[4] += hi - lo
                            open_doc[5] = zlib.crc32(piece, open_doc[5])
                        while len(rows) > 20_000:
                            yield _doc_rows(rows[:20_000])
                            del rows[:20_000]
                    if rows:
                        yield _doc_rows(rows)

    return read


def _doc_rows(rows):
    names = [x.split()[0] for x in ROWS.split(", ")]
    kinds = (pa.int32(), *[pa.int64()] * 5)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)


def read_tokens(spark, path, split_ids=16_000_000):
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document, from the files.

    A file is read in splits of about `split_ids` ids; each decodes the blocks of
    its own documents. ids_crc32 is over the ids as little-endian unsigned 32-bit integers.
    """
    files = files_of(spark, path)
    splits = files.select(
        "part", "at", "file", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("ids") - 1, F.lit(0)), F.lit(split_ids))).alias("first")
    )
    splits = splits.withColumn("last", F.col("first") + split_ids)
    # A given number: the few rows of small files would otherwise be put into one task.
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = splits.repartition(n, "file", "first").mapInArrow(_reader(f"{path}/ids"), ROWS)
    known = files.select("part", "at", "ids_before")
    return rows.join(known, ["part", "at"]).select(
        "doc_id", (F.col("ids_before") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )
