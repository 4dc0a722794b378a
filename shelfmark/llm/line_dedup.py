"""Line deduplication within an edit bound of one word.

A line is its sequence of words (white space apart). Lines are the same if
their words are, and near if one word inserted, deleted or replaced turns one
into the other and the shorter one has at least ``MIN_WORDS`` words. Of equal
lines the first occurrence stays (by doc_id, then place in the text), unless a near line
has an earlier first occurrence, kept or not: the outcome depends on no order of work.

Lines at distance one share a deletion variant: the words without one of them.
All variants are emitted as hashed keys and equal keys meet. A replaced word
leaves the same variant at the same position; an inserted one leaves the other
line itself. Each key's smallest first occurrence is taken by aggregation,
never pairs of a group, and what a line meets is verified by its words. One
edit falls into one third of a line and leaves the other two as they are, so
only thirds whose rest another line shares emit variants. The keys of all
rests are counted, and those of several lines are marked in a bitmap of fixed
size (``BITMAP_BITS``), which all tasks get; a false mark costs its variants
and changes nothing.

Lines without words stay. Null texts stay null. Documents without id stay
unchanged and are not compared. Rows that repeat an id are the same document:
equal lines at the same place stay in all of them. An empty table gives an
empty one; extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.llm.common import bounded_batches, documents, set_apart
from shelfmark.session import materialize

MIN_WORDS = 8
BITMAP_BITS = 27
PARTS = 3
#: Bytes of text, and lines of it, that a task works on in one step.
STEP_BYTES = 4 << 20
STEP_LINES = 1 << 14
#: Bytes whose words are hashed at once.
HASH_BYTES = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def word_hashes(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(words per line, hash of every word) of lines whose words are joined by blanks.

    A word's hash is a polynomial of numbers drawn for its bytes, mixed; all
    words of about ``HASH_BYTES`` are hashed at once.
    """
    lines = pc.cast(lines, pa.large_binary())
    _, offsets, raw = lines.buffers()
    offsets = np.frombuffer(offsets, np.int64)[lines.offset : lines.offset + len(lines) + 1] if len(lines) else np.zeros(1, np.int64)
    raw = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    numbers = np.random.Generator(np.random.PCG64(42)).integers(0, 1 << 64, 256, np.uint64)  # the same in every task
    longest = max(HASH_BYTES, int(np.diff(offsets).max(initial=0)))
    up, down = _powers(_BASE, longest), _powers(_INVERSE, longest)
    many, found, i = [np.empty(0, np.int64)], [np.empty(0, np.uint64)], 0
    while i < len(lines):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + HASH_BYTES, "right")) - 1)
        part, ends = raw[offsets[i] : offsets[j]], offsets[i + 1 : j + 1] - offsets[i]
        blanks = np.flatnonzero(part == 32)
        stop = np.sort(np.concatenate((blanks, ends)))  # ends of words
        start = np.concatenate((np.zeros(1, np.int64), stop[:-1] + (part[np.minimum(stop[:-1], len(part) - 1)] == 32)))
        # a line may begin behind another one without a blank between them: its own first byte is no blank
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(numbers[part] * up[: len(part)])))
        found.append(_mixed((sums[stop] - sums[start]) * down[start] + (stop - start).astype(np.uint64)))
        many.append(np.diff(np.searchsorted(stop, ends, "right"), prepend=0))
        i = j
    return np.concatenate(many).astype(np.int64), np.concatenate(found)


class Lines:
    """Lines as polynomials of their words' hashes."""

    def __init__(self, words: pa.Array):
        """``words``: every line's words, joined by blanks."""
        self.n, h = word_hashes(words)
        self.start = np.cumsum(self.n) - self.n
        inner = np.arange(len(h)) - np.repeat(self.start, self.n)
        top = int(self.n.max(initial=0))
        self.terms = h * _powers(_BASE, top)[inner]
        self.down = _powers(_INVERSE, top)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.terms)))
        self.whole = self.sums[self.start + self.n] - self.sums[self.start]

    def rests(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(role, lines, keys, first, stop): the lines without each of their parts.

        In role 0 the line stands for its own length, in role 1 for the longer
        one of two lines: it then leaves out one word more. ``first`` to
        ``stop`` are the places where the edit may be.
        """
        for role in (0, 1):
            size = self.n - role
            lines = np.flatnonzero(size >= MIN_WORDS)
            size, start = size[lines], self.start[lines]
            for part in range(PARTS):
                first, stop = size * part // PARTS, size * (part + 1) // PARTS + role
                before = self.sums[start + first] - self.sums[start]
                after = self.whole[lines] - (self.sums[start + stop] - self.sums[start])
                rest = before + after * self.down[stop - first]
                seed = (size * PARTS + part + 1).astype(np.uint64) * _BASE
                yield role, lines, _mixed(rest + seed).view(np.int64), first, stop

    def variants(self, lines: np.ndarray, first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(line, key with position, key without) of the lines without each of the words from ``first`` to ``stop``."""
        many = stop - first
        line = np.repeat(lines, many)
        place = np.arange(len(line)) - np.repeat(np.cumsum(many) - many - first, many)
        at = self.start[line] + place
        before = self.sums[at] - self.sums[self.start[line]]
        free = before + (self.whole[line] - before - self.terms[at]) * _INVERSE
        return line, (_mixed(free) + place.astype(np.uint64)).view(np.int64), free.view(np.int64)


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``STEP_BYTES`` of text, at least one row each."""
    for batch in batches:
        upto = np.cumsum(np.asarray(pc.binary_length(batch["text"])))
        start = 0
        while start < batch.num_rows:
            before = upto[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(upto, before + STEP_BYTES, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def _distinct_lines(batches: Iterator[pa.RecordBatch], once: bool = False) -> Iterator[pa.RecordBatch]:
    """The distinct lines of some documents: hash (hi, lo), first occurrence there and words.

    ``once``: only lines that can be near others, and without those that an
    earlier step of the task has had at an earlier place.
    """
    seen: dict[int, int] = {}
    least = MIN_WORDS if once else 1
    for batch in _small(batches):
        lists = pc.split_pattern(batch["text"].cast(pa.large_binary()), b"\n")
        counts = np.diff(lists.offsets.to_numpy())
        coded = lists.flatten().dictionary_encode()
        code = np.asarray(coded.indices)
        doc = np.repeat(np.asarray(batch["doc_id"]), counts)
        place = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
        order = np.lexsort((place, doc))
        first = order[np.unique(code[order], return_index=True)[1]]
        # lines that differ in white space alone have one hash and meet later
        words = [line.split() for line in coded.dictionary.to_pylist()]
        first = first[np.array([len(w) >= least for w in words], bool)]
        joined = [b" ".join(w) for w in words if len(w) >= least]
        for i in range(0, len(joined), STEP_LINES):
            some, at = joined[i : i + STEP_LINES], first[i : i + STEP_LINES]
            raw = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, some)), ">i8").reshape(-1, 2).astype(np.int64)
            part = pa.RecordBatch.from_arrays(
                [pa.array(raw[:, 0]), pa.array(raw[:, 1]), pa.array(doc[at]), pa.array(place[at].astype(np.int32)), pa.array(some, pa.binary())], ["hi", "lo", "doc_id", "place", "words"]
            )
            if once:
                new = []
                for x, d, k in zip(raw[:, 1].tolist(), doc[at].tolist(), place[at].tolist(), strict=True):
                    here = d << 40 | k
                    new.append(here < seen.get(x, here + 1))
                    if new[-1]:
                        seen[x] = here
                part = part.filter(pa.array(new, pa.bool_()))
                if len(seen) > 1 << 18:  # repeated lines only cost their keys again
                    seen.clear()
            yield part


def near(a: list[bytes], b: list[bytes]) -> bool:
    """Whether at most one word inserted, deleted or replaced makes ``a`` out of ``b``."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def line_table(docs: DataFrame) -> DataFrame:
    """One row per distinct line: its 128-bit hash and its first occurrence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _distinct_lines(batches):
            yield part.select(["hi", "lo", "doc_id", "place"])

    each = _texts(docs).mapInArrow(run, "hi long, lo long, doc_id long, place int")
    return each.groupBy("hi", "lo").agg(F.min(F.struct("doc_id", "place")).alias("first"))


def shared_keys(docs: DataFrame) -> np.ndarray:
    """Bitmap of the rest keys that several different lines have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _distinct_lines(batches, once=True):
            lo = np.asarray(part["lo"])
            found = [(keys, lo[at]) for _, at, keys, _, _ in Lines(part["words"]).rests()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[i] for f in found])) for i in (0, 1)], ["key", "line"])

    keys = _texts(docs).mapInArrow(run, "key long, line long")
    shared = keys.groupBy("key").agg(F.min("line").alias("a"), F.max("line").alias("b")).filter("a <> b")
    slot = F.col("key").bitwiseAND(F.lit((1 << BITMAP_BITS) - 1)) + 1
    parts = shared.groupBy(F.bitmap_bucket_number(slot).alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")
    )
    size = (1 << 15) // 8  # bytes of a part
    bitmap = np.zeros((1 << BITMAP_BITS) // 8, np.uint8)
    for r in parts.collect():  # the whole bitmap at most, 16 MB
        bitmap[(r["part"] - 1) * size : r["part"] * size] = np.frombuffer(r["bits"], np.uint8)
    return bitmap


def near_earlier(docs: DataFrame) -> DataFrame:
    """(hi, lo): distinct lines with a near line whose first occurrence is earlier.

    Every task with a line emits all its variants at the line's first place
    there, so that their minima know the line's first occurrence.
    """
    marks = docs.sparkSession.sparkContext.broadcast(shared_keys(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, mask = marks.value, (1 << BITMAP_BITS) - 1
        for part in _distinct_lines(batches, once=True):
            table = Lines(part["words"])
            kinds, keys, owners = [], [], []
            for role, at, rest, first, stop in table.rests():
                marked = np.flatnonzero(bitmap[(rest & mask) >> 3] >> (rest & 7).astype(np.uint8) & 1)
                line, placed, free = table.variants(at[marked], first[marked], stop[marked])
                # kinds: 0 the line itself, 1 a variant to meet a line itself, 2 a variant at its position
                kinds.append(np.full(len(line), 1 if role else 2, np.int32))
                keys.append(free if role else placed)
                owners.append(line)
            itself = np.unique(np.concatenate(owners))
            kinds.append(np.zeros(len(itself), np.int32))
            keys.append(table.whole[itself].view(np.int64))
            owner = np.concatenate([*owners, itself])
            kind = np.concatenate(kinds)
            # the words travel once per line, with the line itself
            words = part["words"].take(pa.array(owner, mask=kind != 0))
            at = pa.array(owner)
            columns = [pa.array(kind), pa.array(np.concatenate(keys)), *(part[c].take(at) for c in ("hi", "lo", "doc_id", "place")), words]
            yield pa.RecordBatch.from_arrays(columns, ["kind", "key", "hi", "lo", "doc_id", "place", "words"])

    emitted = _texts(docs).mapInArrow(run, "kind int, key long, hi long, lo long, doc_id long, place int, words binary")
    # a line in many documents emits the same rows in many tasks
    keys = emitted.groupBy("hi", "lo", "kind", "key").agg(F.min(F.struct("doc_id", "place")).alias("first"), F.min("words").alias("words"))
    itself, at = F.col("kind") == 0, F.col("kind") == 2
    # a line's hash is needed once; elsewhere its first occurrence stands for it
    own = [F.when(itself, F.col(c)).alias(c) for c in ("hi", "lo")]
    named = materialize(keys.select("kind", "key", "first", *own, "words", at.alias("at")), "variants")
    # ``alone``: the line itself; of variants at their position the last one, which tells whether there is another
    best = named.groupBy("key", "at").agg(
        F.min(F.when(~itself, F.col("first"))).alias("earliest"),
        F.max(F.when(itself | at, F.col("first"))).alias("alone"),
    )
    # keys of one line alone meet nothing
    best = best.filter("earliest <> alone")
    met = F.when(at | itself, F.col("earliest")).otherwise(F.col("alone"))
    found = named.select("kind", "key", "at", "first").join(best, ["key", "at"]).withColumn("met", met).filter("met < first")
    pairs = found.select("first", "met").distinct()
    # each line with the earliest lines it meets, verified by their words
    texts = named.filter("kind = 0").select("hi", "lo", "first", "words")
    other = texts.select(F.col("first").alias("met"), F.col("words").alias("met_words"))
    same = pairs.join(texts, "first").join(other, "met")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            good = [near(a.split(b" "), b.split(b" ")) for a, b in zip(batch["words"], batch["met_words"], strict=True)]
            yield batch.loc[good, ["hi", "lo"]]

    return same.select("hi", "lo", "words", "met_words").mapInPandas(check, "hi long, lo long").distinct()


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with new texts."""
    inside, back = set_apart(docs, "doc_id", "text")
    return back(with_counts(inside))


def with_counts(docs: DataFrame) -> DataFrame:
    """``docs`` with new texts, and ``n_lines`` and ``n_dropped`` of each."""
    known = docs.filter("doc_id is not null and text is not null")
    lines = materialize(line_table(known), "lines")
    kept = lines.join(near_earlier(known), ["hi", "lo"], "left_anti").select("first.doc_id", "first.place")
    per_doc = kept.groupBy("doc_id").agg(F.collect_list("place").alias("_places"))
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    counts = [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]
    schema = T.StructType([*(docs.schema[c] for c in names), *counts])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            for text, places in zip(batch["text"], batch["_places"], strict=True):
                want, all_lines = set(() if places is None else places), text.split("\n")
                left = [x for i, x in enumerate(all_lines) if i in want or not x.strip(" \t\x0b\x0c\r")]
                texts.append("\n".join(left))
                n_lines.append(len(all_lines))
                n_dropped.append(len(all_lines) - len(left))
            yield batch[names].assign(text=texts, n_lines=n_lines, n_dropped=n_dropped)

    done = known.select(*names).join(per_doc, "doc_id", "left").select(*names, "_places").mapInPandas(run, schema)
    rest = docs.filter("doc_id is null or text is null").select(*names)
    n = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(F.split("text", "\n"))).cast("long")
    return done.unionByName(rest.withColumns({"n_lines": n, "n_dropped": F.lit(0).cast("long")}))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return with_counts(documents(spark, sf_dir).select("doc_id", "text"))


OP10_SQL = """
with l as (select doc_id, text, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as place from documents),
w as (select doc_id, place, line, list_filter(regexp_split_to_array(line, '[ \\t\\x0b\\x0c\\r]+'), lambda x: x <> '') as words from l),
d as (select words, len(words) as n, min((doc_id, place)) as first from w where len(words) > 0 group by words),
v as (select words, first, n, unnest(range(1, n + 1)) as p from d where n >= 8),
k as (select words, first, n, p, words[:p - 1] || words[p + 1:] as key from v),
same_place as (select key, p, min(first) as earliest from k group by key, p),
inserted as (select k.words as longer, k.first as longer_first, d.words as shorter, d.first as shorter_first from k join d on d.words = k.key and d.n >= 8),
met as (
    select words, first, earliest from k join same_place using (key, p)
    union all select longer, longer_first, shorter_first from inserted
    union all select shorter, shorter_first, longer_first from inserted),
gone as (select distinct words from met where earliest < first),
kept as (select first from d where words not in (select words from gone)),
marked as (
    select w.*, len(words) = 0 or (doc_id, place) in (select first from kept) as stays from w)
select d0.doc_id, case when d0.text is null then 0 else count(m.place) end as n_lines,
    count(*) filter (not m.stays) as n_dropped,
    case when d0.text is not null then coalesce(string_agg(m.line, chr(10) order by m.place) filter (m.stays), '') end as text
from documents d0 left join marked m using (doc_id) group by d0.doc_id, d0.text
"""
