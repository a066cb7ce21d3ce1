"""Problem 8: passages of evaluation items inside a training corpus.

Each slice of the corpus gets a suffix array over its words, and every suffix of every test
item is looked up in it by binary search; the longest verbatim match of each and its place
come out. Only suffixes that can match are put into the array: a passage of at least
``min_words`` words of a test item consists of word pairs that occur in test items, so
positions where a shorter chain of such pairs begins are left out beforehand, losing nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.session import cut, table

WORD = re.compile(r"[a-z0-9]+")
COMMAND = re.compile(r"\\[A-Za-z]+")
#: Letters outside ASCII whose lower case begins with an ASCII letter (fixed values).
FOLDED = (("K".encode(), b"k"), ("İ".encode(), b"i\xcc\x87"))
#: Characters of test items per pass over the corpus, a bound on what every task holds; larger sets take several passes.
ITEM_CHARS_PER_PASS = 200_000_000
SLICE_BYTES = 4 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    """The words of a text as the operator sees them: commands dropped, lower-cased, ASCII runs."""
    return WORD.findall(COMMAND.sub("", text).lower())


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    base = 0x100000001B3
    inverse = pow(base, -1, 1 << 64)
    up = np.full(n, base, np.uint64)
    down = np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def word_hashes(data: np.ndarray, doc_starts: np.ndarray, up: np.ndarray, down: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, document of each word)`` of the UTF-8 bytes of several texts laid end to end.

    Commands are cut out first, as ``words_of`` does. The hash of a word is a polynomial in its
    bytes, taken from one running sum over the slice.
    """
    lower = np.where((data >= 65) & (data <= 90), data + 32, data)
    letter = (lower >= 97) & (lower <= 122)
    slash = np.flatnonzero(data == 92)
    slash = slash[slash + 1 < len(data)]
    slash = slash[letter[slash + 1] & ~np.isin(slash + 1, doc_starts)]
    if len(slash):
        edge = letter.copy()
        edge[doc_starts[doc_starts < len(data)]] = False
        stops = np.append(np.flatnonzero(~edge), len(data))
        ends = stops[np.searchsorted(stops, slash + 1)]
        delta = np.zeros(len(data) + 1, np.int8)
        np.add.at(delta, slash, 1)
        np.add.at(delta, ends, -1)
        gone = np.cumsum(delta[:-1], dtype=np.int32) > 0
        shift = np.concatenate(([0], np.cumsum(gone)))
        doc_starts = doc_starts - shift[doc_starts]
        lower = lower[~gone]
    n = len(lower)
    inside = ((lower >= 97) & (lower <= 122)) | ((lower >= 48) & (lower <= 57))
    before = np.concatenate(([False], inside[:-1]))
    before[doc_starts[doc_starts < n]] = False
    starts = np.flatnonzero(inside & ~before)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    after = np.concatenate((inside[1:], [False]))
    last = doc_starts[(doc_starts > 0) & (doc_starts <= n)] - 1
    after[last] = False
    ends = np.flatnonzero(inside & ~after) + 1
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(lower.astype(np.uint64) * up[:n], dtype=np.uint64)))
    h = (sums[ends] - sums[starts]) * down[starts]
    h ^= (ends - starts).astype(np.uint64) * _MIX
    return h, np.searchsorted(doc_starts, starts, "right") - 1


class TestSet:
    """The words of the test items, their suffixes in order, and the pairs that occur in them."""

    def __init__(self, texts: list[str], min_words: int):
        self.min_words = min_words
        lists = [words_of(t or "") for t in texts]
        flat = [w for ws in lists for w in ws]
        vocabulary = sorted(set(flat))
        number = {w: i + 1 for i, w in enumerate(vocabulary)}
        lengths = np.array([len(x) for x in lists], np.int64)
        self.item_start = np.concatenate(([0], np.cumsum(lengths)))
        self.words = np.array([number[w] for w in flat] + [0] * (min_words + 1), np.int64)
        data = np.frombuffer("\x00".join(vocabulary).encode() or b"\x00", np.uint8)
        up, down = _powers(len(data) + 1)
        h, _ = word_hashes(data, np.zeros(1, np.int64), up, down)
        order = np.argsort(h)
        self.hash_sorted, self.hash_number = h[order], order.astype(np.int64) + 1
        item_of = np.repeat(np.arange(len(lists)), lengths)
        places = np.arange(len(flat)) if len(flat) else np.zeros(0, np.int64)
        left = self.item_start[item_of + 1] - places if len(flat) else places
        self.suffixes = places[left >= min_words]
        self.item_of, self.left = item_of, left
        self.tests = np.ascontiguousarray(self.words[self.suffixes[:, None] + np.arange(min_words)].astype(">u4")).view(f"S{4 * min_words}").ravel()
        self.width = len(vocabulary) + 2
        inner = places[left >= 2]
        self.pairs = np.unique(self.words[inner] * self.width + self.words[inner + 1])

    def search(self, h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
        """``(doc, item, word in slice, word in item, length)``, one array each, of the maximal matches in a
        slice's words."""
        m, none = self.min_words, tuple(np.zeros(0, np.int64) for _ in range(5))
        if len(h) < m or not len(self.suffixes):
            return none
        at = np.searchsorted(self.hash_sorted, h)
        at[at == len(self.hash_sorted)] = 0
        w = np.where(self.hash_sorted[at] == h, self.hash_number[at], 0)
        code = w[:-1] * self.width + w[1:]
        where = np.searchsorted(self.pairs, code)
        where[where == len(self.pairs)] = 0
        chained = (w[:-1] > 0) & (w[1:] > 0) & (doc[:-1] == doc[1:]) & (self.pairs[where] == code)
        run = np.concatenate(([0], np.cumsum(chained)))
        n = len(h) - m + 1
        starts = np.flatnonzero(run[m - 1 : m - 1 + n] - run[:n] == m - 1)
        if not len(starts):
            return none
        # the suffix array of the slice: its suffixes, to the depth of the shortest match
        rows = np.ascontiguousarray(w[starts[:, None] + np.arange(m)].astype(">u4")).view(f"S{4 * m}").ravel()
        order = np.argsort(rows, kind="stable")
        array, places = rows[order], starts[order]
        lo, hi = np.searchsorted(array, self.tests, "left"), np.searchsorted(array, self.tests, "right")
        hits = hi - lo
        suffix = np.repeat(np.arange(len(hits)), hits)
        i = places[np.arange(len(suffix)) - np.repeat(np.cumsum(hits) - hits, hits) + np.repeat(lo, hits)]
        j = self.suffixes[suffix]
        item = self.item_of[j]
        # a match that begins earlier covers this one
        earlier = (i > 0) & (j > self.item_start[item]) & (w[np.maximum(i, 1) - 1] == self.words[np.maximum(j, 1) - 1]) & (doc[np.maximum(i, 1) - 1] == doc[i])
        i, j, item = i[~earlier], j[~earlier], item[~earlier]
        length, growing = np.full(len(i), m), np.arange(len(i))
        while len(growing):
            k, at, to = length[growing], i[growing], j[growing]
            more = (k < self.left[to]) & (at + k < len(w))
            growing, k, at, to = growing[more], k[more], at[more], to[more]
            more = (w[at + k] == self.words[to + k]) & (doc[at + k] == doc[at])
            growing = growing[more]
            length[growing] += 1
        return doc[i], item, i, j - self.item_start[item], length


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Parts of a batch of (id, text) with about SLICE_BYTES of text: ids, bytes, document starts."""
    ids, text = batch.column(0), batch.column(1).fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(text):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE_BYTES, "right")) - 1)
        yield ids.slice(lo, hi - lo), data[offsets[lo] : offsets[hi]], offsets[lo:hi] - offsets[lo]
        lo = hi


def leaked_passages(documents: DataFrame, items: DataFrame, min_words: int = 12, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "item_text") -> DataFrame:
    """``(doc_id, item_id, doc_word, item_word, n_words)``: the maximal passages of at least
    ``min_words`` words that a document shares with a test item, and where they begin.

    One pass over the corpus without a shuffle for any test set of up to ITEM_CHARS_PER_PASS
    characters; its size is checked, and larger ones take a pass for each such part. The set is
    prepared once and broadcast. Words are compared by a 64-bit hash against the test vocabulary,
    then by number.

    Null and empty texts hold nothing; items under ``min_words`` words are never found; repeated
    documents are reported each, repeated items too; other columns are ignored.
    """
    wanted = items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).where("t is not null and i is not null")
    chars = wanted.agg(F.sum(F.length("t"))).first()[0] or 0
    parts = max(1, -(-chars // ITEM_CHARS_PER_PASS))
    kind, ikind = dict(documents.dtypes)[id_col], dict(items.dtypes)[item_id]
    corpus = documents.select(id_col, text_col).where(F.col(text_col).isNotNull())
    out = None
    for p in range(parts):
        rows = wanted.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == p).toArrow()
        item_ids = rows.column("i").combine_chunks()
        shipped = documents.sparkSession.sparkContext.broadcast(TestSet(rows.column("t").to_pylist(), min_words))

        def run(batches: Iterator[pa.RecordBatch], item_ids=item_ids, shipped=shipped) -> Iterator[pa.RecordBatch]:
            tests = shipped.value
            up, down = _powers(SLICE_BYTES + 1)
            for b in batches:
                for doc_ids, data, starts in _slices(b):
                    if len(data) > len(up) - 2:
                        up, down = _powers(len(data) + 2)
                    for letter, folded in FOLDED:
                        if letter in data.tobytes():
                            texts_here = [data[s:e].tobytes().replace(letter, folded) for s, e in zip(starts, [*starts[1:], len(data)], strict=True)]
                            starts = np.concatenate(([0], np.cumsum([len(x) for x in texts_here])[:-1])).astype(np.int64)
                            data = np.frombuffer(b"".join(texts_here), np.uint8)
                    h, doc = word_hashes(data, starts, up, down)
                    first = np.searchsorted(doc, np.arange(len(starts)))
                    d, i, w, j, k = tests.search(h, doc)
                    if len(d):
                        yield pa.RecordBatch.from_arrays(
                            [doc_ids.take(pa.array(d)), item_ids.take(pa.array(i)), *[pa.array(x.astype(np.int32)) for x in (w - first[d], j, k)]], ["doc_id", "item_id", "doc_word", "item_word", "n_words"]
                        )

        one = corpus.mapInArrow(run, f"doc_id {kind}, item_id {ikind}, doc_word int, item_word int, n_words int")
        out = one if out is None else out.unionByName(one)
    return out


def decontaminated(documents: DataFrame, passages: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents without leaked passages; documents without an id stay."""
    bad = passages.select(F.col("doc_id").alias("leaked")).distinct()
    return documents.join(bad, F.col(id_col) == F.col("leaked"), "left_anti")


def p8_found(spark, sf_dir: str) -> DataFrame:
    found = leaked_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return found.select("doc_id", "item_id").distinct()


def p8_passages(spark, sf_dir: str) -> DataFrame:
    """Every leaked passage with its place and length in words."""
    return leaked_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_clean(spark, sf_dir: str) -> DataFrame:
    """The documents that hold no passage of a test item, with their length."""
    documents = table(spark, sf_dir, "documents")
    passages = cut(leaked_passages(documents, table(spark, sf_dir, "eval_items")))
    return decontaminated(documents, passages).select("doc_id", "source", "n_chars")


P8_SQL = r"""
with w as (select doc_id, regexp_extract_all(lower(regexp_replace(text, '\\[A-Za-z]+', '', 'g')), '[a-z0-9]+') w from documents where text is not null),
i as (select item_id, regexp_extract_all(lower(regexp_replace(item_text, '\\[A-Za-z]+', '', 'g')), '[a-z0-9]+') w from eval_items where item_text is not null),
g as (select distinct item_id, array_to_string(w[k:k + 11], ' ') gram from (select item_id, w, unnest(range(1, len(w) - 10)) k from i)),
d as (select doc_id, array_to_string(w[k:k + 11], ' ') gram from (select doc_id, w, unnest(range(1, len(w) - 10)) k from w))
select distinct doc_id, item_id from d join g using (gram)
"""

P8_CLEAN_SQL = f"select doc_id, source, n_chars from documents where doc_id not in (select doc_id from ({P8_SQL}))"
