"""Evaluation texts leaking into training text: a character q-gram filter over diagonals, then banded alignment of what it leaves.

Texts become streams of folded letters and digits; spacing, case, punctuation, markup and character variants are gone, and word
edges are kept beside them. By the q-gram lemma a stretch of m characters with at most e edits shares m - q + 1 - q * e q-grams with its source.

1. The q-grams of all items make a sieve of bounded size. Documents are read once: only where, within the length of the shortest countable
   stretch, enough q-grams pass the sieve, a region of the document is kept, in whole words. Equal regions are looked at once.
2. Regions meet item texts over their rarest q-gram in every such window, so a q-gram that many items share is used only where nothing rarer
   is; long lists of items under a q-gram are joined in blocks. There is no limit to the number of items.
3. Of each pair that meets, the shared q-grams are counted in overlapping bands of diagonals; where a band holds as many as the text's shortest
   countable stretch must have, q-grams on one diagonal form seeds, which are extended on the diagonals of a band by as many edits as the
   budget permits (none, in the stated cases). The aligned whole words decide.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_left, bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessela.runtime import broadcast_if_small, checkpoint, shuffle_partitions, ship, unpack

Q = 8
#: Bits of the sieve for each different q-gram, and bits that it has at most (64 MB).
SIEVE_BITS, MOST_BITS = 16, 1 << 29
#: Items under one q-gram that are joined within a group; a longer list is split.
BLOCK = 1_024
#: Diagonals of a band.
BAND = 32
#: Characters of documents that are looked up at a time.
_STEP = 1 << 20
_PAGE = 16

_MARKUP = re.compile(r"<[^<>\n]+>|\]\([^()\s]*\)|```|https?://\S+")
_WORD = re.compile(r"[^\W_]+")
# Letters that Unicode's decomposition leaves whole, and Cyrillic and Greek twins of Latin letters.
_FOLD = str.maketrans({
    "ø": "o", "ł": "l", "đ": "d", "ı": "i", "æ": "ae", "œ": "oe", "þ": "th", "ð": "d", "ħ": "h", "ŧ": "t",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s", "к": "k", "м": "m", "т": "t", "н": "h", "в": "b",
    "ο": "o", "α": "a", "ν": "v", "ι": "i", "ρ": "p", "τ": "t",
})
_IGNORED = re.compile("[­​-‏⁠﻿̀-ͯ]")
_HYPHENATED = re.compile(r"(?<=[^\W\d_])-[ \t]*\r?\n[ \t>]*(?=[^\W\d_])")


def fold(text: str) -> str:
    text = html.unescape(text) if "&" in text else text
    text = _MARKUP.sub(" ", text) if "<" in text or "](" in text or "`" in text or "http" in text else text
    text = _HYPHENATED.sub("", text) if "-" in text else text
    if text.isascii():
        return text.lower()
    return _IGNORED.sub("", unicodedata.normalize("NFKD", text).casefold()).translate(_FOLD)


def words_of(text: str) -> list[str]:
    return _WORD.findall(fold(text))


def least_characters(words: list[str], count: int) -> int | None:
    """The fewest characters that so many consecutive words have; None if there aren't as many."""
    if len(words) < count:
        return None
    ends = np.cumsum([len(w) for w in words])
    return int((ends[count - 1 :] - np.concatenate([[0], ends[:-count]])).min())


def _symbols(text: str) -> np.ndarray:
    """A byte for each character: letters and digits their own, other characters one of 219."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter, digit = (raw >= 97) & (raw <= 122), (raw >= 48) & (raw <= 57)
    return np.where(letter, raw - 96, np.where(digit, raw - 21, 37 + raw % 219)).astype(np.uint8)


def grams(text: str) -> np.ndarray:
    """The q-grams of a text as numbers; those of characters that share a byte may coincide, which the alignment finds out."""
    codes = _symbols(text).astype(np.uint64)
    n = len(codes) - Q + 1
    if n < 1:
        return np.empty(0, np.int64)
    out = np.zeros(n, np.uint64)
    for i in range(Q):
        out |= codes[i : i + n] << np.uint64(8 * i)
    return out.view(np.int64)


def _slots(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def regions(documents: list[list[str]], sieve: np.ndarray, bits: int, window: int, bound: int, longest: int) -> list[tuple[int, list[str]]]:
    """(document, words): the stretches of whole words around every window of q-grams of which at least bound pass the sieve. A very long region
    is cut into pieces that overlap by the longest text, so any stretch lies in one of them."""
    text = "".join(w for words in documents for w in words)
    keys = grams(text)
    if len(keys) < window:
        return []
    sizes = np.array([len(w) for words in documents for w in words], np.int64)
    ends = np.cumsum(sizes)
    first = np.cumsum([0, *map(len, documents)])
    begin = np.concatenate([[0], ends])[first]
    slots = _slots(keys, bits)
    passed = np.concatenate([[0], np.cumsum((sieve[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1, dtype=np.int64)])
    # No window of one document reaches into the next.
    starts = np.flatnonzero(passed[window:] - passed[:-window] >= bound)
    doc = np.searchsorted(begin, starts, "right") - 1
    fits = starts + window + Q - 1 <= begin[doc + 1]
    starts, doc = starts[fits], doc[fits]
    if not len(starts):
        return []
    reach = window + Q - 1
    new = np.concatenate([[True], (np.diff(starts) > reach) | (np.diff(doc) != 0)])
    lows, highs, owners = starts[new], starts[np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)] + reach, doc[new]
    flat = [w for words in documents for w in words]
    out, most = [], max(4_096, 4 * longest)
    for lo, hi, owner in zip(lows.tolist(), highs.tolist(), owners.tolist()):
        a, b = int(np.searchsorted(ends, lo, "right")), int(np.searchsorted(ends, hi, "left")) + 1
        while a < b:
            z = min(b, max(a + 1, int(np.searchsorted(ends, ends[a] + most, "right"))))
            out.append((owner, flat[a:z]))
            if z == b:
                break
            a = max(a + 1, min(z - 1, int(np.searchsorted(ends, ends[z - 1] - longest, "left"))))
    return out


def _furthest(a: str, b: str, i: int, j: int, edits: int, step: int) -> list[tuple[int, int]]:
    """For 0, 1, ... edits the furthest (i, j) that an alignment of a and b reaches from here, forwards or backwards: on each diagonal of
    the band only the furthest point is kept."""
    limit_a, limit_b = (len(a), len(b)) if step > 0 else (-1, -1)

    def slide(x: int, y: int) -> tuple[int, int]:
        while x != limit_a and y != limit_b and a[x] == b[y]:
            x, y = x + step, y + step
        return x, y

    points, out = {0: slide(i, j)}, []
    for spent in range(edits + 1):
        out.append(max(points.values(), key=lambda p: (p[0] * step, p[1] * step)))
        if spent == edits:
            break
        after: dict[int, tuple[int, int]] = {}
        for d, (x, y) in points.items():
            for dx, dy in ((1, 1), (1, 0), (0, 1)):
                u, v = x + dx * step, y + dy * step
                if dx and x == limit_a or dy and y == limit_b:
                    continue
                reached = slide(u, v)
                key = d + dx - dy
                if key not in after or reached[0] * step > after[key][0] * step:
                    after[key] = reached
        points = {**points, **after}
    return out


class Side:
    """A text or a region with what its comparisons need: the joined words, where words begin and end, and the places of its q-grams."""

    def __init__(self, words: list[str]):
        self.count, self.text = len(words), "".join(words)
        self.starts = np.cumsum([0, *map(len, words)]).tolist()
        self.edges = set(self.starts)
        self.grams = [self.text[i : i + Q] for i in range(len(self.text) - Q + 1)]
        self.places: dict[str, list[int]] = {}
        for i, gram in enumerate(self.grams):
            self.places.setdefault(gram, []).append(i)
        self.plain = len(self.places) == len(self.grams)


def promising(document: Side, text: Side, bound: int, edits: int = 0) -> bool:
    """Whether a band of diagonals holds at least ``bound`` shared q-grams. Bands overlap by half, so that any stretch, which strays by no more
    than its edits, lies in one of them."""
    if text.plain and len(text.places.keys() & document.places.keys()) < bound:
        return False
    half = BAND // 2 + edits
    bands: dict[int, int] = {}
    get = document.places.get
    for i, gram in enumerate(text.grams):
        for j in get(gram, ()):
            at = (j - i) // half
            bands[at] = bands.get(at, 0) + 1
    return any(n + bands.get(at + 1, 0) >= bound for at, n in bands.items()) or any(n >= bound for n in bands.values())


def aligned(document: Side, text: Side, run_words: int, part_words: int, edits: int = 0) -> tuple[bool, list[int]]:
    """Whether the document repeats run_words consecutive words of the text within the edit budget, and the numbers of the text's words that
    stand in stretches of at least part_words. A word at a stretch's edge counts only where the document has a word's edge as well."""
    a, b, starts_a, edges = text.text, document.text, text.starts, document.edges
    ended: dict[int, int] = {}
    seen, covered, run = set(), set(), False
    for i, gram in enumerate(text.grams):
        for j in document.places.get(gram, ()):
            if ended.get(j - i, -1) >= i:
                continue  # inside a seed that was extended from its start
            forward, backward = _furthest(a, b, i, j, edits, 1), _furthest(a, b, i - 1, j - 1, edits, -1)
            ended[j - i] = forward[0][0] - Q
            for spent, (hi, hi_b) in enumerate(forward):
                lo, lo_b = backward[edits - spent]
                stretch = (lo + 1, lo_b + 1, hi, hi_b)
                if stretch in seen:
                    continue
                seen.add(stretch)
                x, y = bisect_left(starts_a, stretch[0]), bisect_right(starts_a, hi) - 1
                while x < y and starts_a[x] - stretch[0] + stretch[1] not in edges:
                    x += 1
                while y > x and starts_a[y] - hi + hi_b not in edges:
                    y -= 1
                run |= y - x >= run_words
                if y - x >= part_words:
                    covered.update(range(x, y))
    return run, sorted(covered)


def _texts(items: DataFrame) -> DataFrame:
    """items(item_id, passage, question) -> (item_id, half, words)."""

    def run(batches):
        for batch in batches:
            ids, halves, words = [], [], []
            for item, passage, question in zip(*[batch.column(c).to_pylist() for c in range(3)]):
                for half, text in ((True, passage), (False, question)):
                    found = words_of(text) if text else []
                    if found:
                        ids.append(item)
                        halves.append(half)
                        words.append(" ".join(found))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(halves, pa.bool_()), pa.array(words, pa.string())], ["item_id", "half", "words"])

    return items.mapInArrow(run, "item_id long, half boolean, words string")


def _grams_of(rows: DataFrame, no: str) -> DataFrame:
    """rows(no, words) -> (no, pos, gram)."""

    def run(batches):
        for batch in batches:
            for number, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys = grams(words.replace(" ", ""))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), number, np.int64)), pa.array(np.arange(len(keys), dtype=np.int32)), pa.array(keys)], [no, "pos", "gram"])

    return rows.select(no, "words").mapInArrow(run, f"{no} long, pos int, gram long")


def _sieve(counted: DataFrame, distinct: int) -> tuple[np.ndarray, int]:
    """counted(gram) -> (bits, their logarithm). Pages of the sieve are made by tasks; the driver puts at most 64 MB of them together."""
    bits = max(_PAGE, min(MOST_BITS, max(1, distinct) * SIEVE_BITS).bit_length())

    def slots(batches):
        for batch in batches:
            slot = np.unique(_slots(batch.column(0).to_numpy(), bits))
            yield pa.RecordBatch.from_arrays([pa.array((slot >> _PAGE).astype(np.int32)), pa.array((slot & ((1 << _PAGE) - 1)).astype(np.int32))], ["page", "slot"])

    def pages(pdf):
        import pandas as pd

        page = np.zeros(1 << _PAGE, np.uint8)
        page[pdf["slot"].to_numpy()] = 1
        return pd.DataFrame({"page": pdf["page"][:1], "bits": [np.packbits(page, bitorder="little").tobytes()]})

    made = counted.select("gram").mapInArrow(slots, "page int, slot int").groupBy("page").applyInPandas(pages, "page int, bits binary")
    sieve = np.zeros(1 << (bits - 3), np.uint8)
    size = 1 << (_PAGE - 3)
    for row in made.toLocalIterator():
        sieve[row["page"] * size : (row["page"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    return sieve, bits


def _numbered(df: DataFrame, name: str) -> DataFrame:
    return checkpoint(df.withColumn(name, F.monotonically_increasing_id()))


def leaks(
    documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", passage: str = "passage",
    question: str = "question", run_words: int = 12, part_words: int = 6, share: float = 0.5, edits: int = 0, block: int = BLOCK,
) -> DataFrame:
    """(doc_id, item_id): each document with the items that it gives away; items that share a passage come out together.

    edits: so many characters may be changed, added or left out within a stretch.

    Defined cases: null ids, null and blank texts give nothing; repeated rows count once; a passage of fewer than
    part_words words, or a question of fewer than run_words, can't leak; empty tables give no rows. Documents are read whole.
    """
    spark = documents.sparkSession
    schema = "doc_id long, item_id long"
    held = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(passage).alias("p"), F.col(question).alias("q")).where("item_id IS NOT NULL")
    owned = checkpoint(_texts(held).distinct())
    fewest = F.when(F.col("half"), F.lit(min(part_words, run_words))).otherwise(F.lit(run_words))
    whole = owned.where(F.size(F.split("words", " ")) >= fewest).select("half", "words").distinct()

    def lengths(batches):
        for batch in batches:
            halves, words = batch.column(0), batch.column(1)
            least = [least_characters(w.split(" "), min(part_words, run_words) if h else run_words) for h, w in zip(halves.to_pylist(), words.to_pylist())]
            yield pa.RecordBatch.from_arrays([halves, words, pa.array(least, pa.int64())], ["half", "words", "least"])

    texts = _numbered(whole.mapInArrow(lengths, "half boolean, words string, least long"), "text_no")
    bounds = texts.agg(F.min("least").alias("least"), F.max(F.length("words")).alias("longest")).first()
    if bounds["least"] is None:
        return spark.createDataFrame([], schema)
    longest = int(bounds["longest"]) + edits
    window = max(1, int(bounds["least"]) - edits - Q + 1)
    bound = max(1, window - Q * edits)
    postings = checkpoint(_grams_of(texts, "text_no").select("gram", "text_no").distinct())
    counted = checkpoint(postings.groupBy("gram").agg(F.count(F.lit(1)).alias("df")))
    sieve, bits = _sieve(counted, counted.count())
    shipped = ship(spark, (sieve, bits))
    del sieve

    def search(batches):
        own, size = unpack(shipped)

        def found(ids, docs):
            hits = regions(docs, own, size, window, bound, longest)
            return pa.RecordBatch.from_arrays([pa.array([ids[d] for d, _ in hits], pa.int64()), pa.array([" ".join(w) for _, w in hits], pa.string())], ["doc_id", "words"])

        for batch in batches:
            ids, docs, size_now = [], [], 0
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(d)
                docs.append(words_of(t))
                size_now += len(t)
                if size_now > _STEP:
                    yield found(ids, docs)
                    ids, docs, size_now = [], [], 0
            if ids:
                yield found(ids, docs)

    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id IS NOT NULL AND length(text) > 0")
    cut = checkpoint(docs.mapInArrow(search, "doc_id long, words string"))
    parts = _numbered(cut.select("words").distinct(), "region_no")
    # The rarest q-gram of every window that can lie in a countable stretch.
    known = _grams_of(parts, "region_no").join(counted, "gram")
    ahead = Window.partitionBy("region_no").orderBy("pos").rangeBetween(0, window - 1)
    rarest = known.select("region_no", F.count(F.lit(1)).over(ahead).alias("c"), F.min(F.struct("df", "gram")).over(ahead).alias("x")).where(F.col("c") >= bound)
    # A region that is shorter than the shortest countable stretch of a text holds none of it.
    size = parts.select("region_no", F.length(F.regexp_replace("words", " ", "")).alias("size"))
    asked = rarest.select("region_no", "x.gram", "x.df").distinct().join(size, "region_no")
    blocks = F.ceil(F.col("df") / F.lit(block)).cast("long")
    left = asked.select("region_no", "size", "gram", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("part"))
    right = postings.join(counted, "gram").join(texts.select("text_no", "least"), "text_no").select("gram", "text_no", "least", F.pmod(F.xxhash64("text_no"), blocks).alias("part"))
    pairs = checkpoint(left.join(right, ["gram", "part"]).where(F.col("size") >= F.col("least") - edits).select("region_no", "text_no").distinct())

    def verify(batches):
        now, region_side = None, None

        @lru_cache(4096)
        def prepared(words: str) -> Side:
            return Side(words.split(" "))

        for batch in batches:
            rows = []
            for region, no, half, least, r, t in zip(*[batch.column(c).to_pylist() for c in range(6)]):
                if region != now:
                    now, region_side = region, Side(r.split(" "))
                side = prepared(t)
                if not promising(region_side, side, max(1, least - edits - Q + 1 - Q * edits), edits):
                    continue
                run, covered = aligned(region_side, side, run_words, part_words, edits)
                if run or half and covered:
                    rows.append((region, no, run, covered if half and not run else [], side.count))
            columns = list(zip(*rows)) if rows else [()] * 5
            types = [pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int32()), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], ["region_no", "text_no", "run", "covered", "n"])

    met = pairs.join(parts, "region_no").join(texts.withColumnRenamed("words", "own"), "text_no").select("region_no", "text_no", "half", "least", "words", "own")
    met = met.repartition(shuffle_partitions(spark), "region_no", F.pmod(F.xxhash64("text_no"), F.lit(8))).sortWithinPartitions("region_no")
    proven = checkpoint(met.mapInArrow(verify, "region_no long, text_no long, run boolean, covered array<int>, n int"))
    placed = cut.distinct().join(parts, "words").select("doc_id", "region_no").join(broadcast_if_small(proven, 200_000), "region_no")
    told = placed.groupBy("doc_id", "text_no").agg(F.max("run").alias("run"), F.size(F.array_distinct(F.flatten(F.collect_list("covered")))).alias("c"), F.max("n").alias("n"))
    leaked = told.where(F.col("run") | (F.col("c") >= F.col("n") * F.lit(share)) & (F.col("c") > 0)).select("doc_id", "text_no")
    owners = texts.join(owned, ["half", "words"]).select("text_no", "item_id")
    return leaked.join(owners, "text_no").select("doc_id", "item_id").distinct()
