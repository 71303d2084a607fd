"""Per-document text statistics that tell running prose from lists, tables, markup and junk.

A document is cut into pieces of bounded length, and each piece is counted by itself: totals of its closed lines by kind, and
the open counts of its first and last line fragment with what a neighbour may change. Two parts add up associatively; the sum joins the
fragments that meet, corrects what crosses the cut and judges the line once it is whole. A cut moves on to the end of
the next blanks. Only where none are near does it go through a token, which is then longer than any that is looked up: its
length, ends and kinds of letters travel as the open token. So every document takes one path, and the cuts change nothing.

The parts of a document merge within its task; a huge document's pieces are spread over tasks and merged by a tree. All
pieces of a batch are counted together, by arrays over their characters, tokens and lines.
"""

from __future__ import annotations

import marshal
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessela.runtime import shuffle_partitions

#: Characters of a piece, about.
PIECE = 2_048
#: A document of more characters is counted by several tasks, in stretches of this many.
SPREAD = 1 << 20
#: Neighbouring stretches that merge in the first level of the tree.
FAN_IN = 8
#: Characters within which a cut looks for blanks; longer than WORD, so a token that is cut is none that is looked up.
REACH = 256
#: A longer token has no common, harsh or repeated word in it.
WORD = 64
#: Characters of a batch that are counted at a time.
_BLOCK = 1 << 20

# Common function words of English, German, French and Spanish.
COMMON = frozenset(
    """a about after all an and any are as at be because been before but by can could did do does each every for from had has have he her his how i if in
    into is it its just me more most my no not of on one only or other our out over she should so some than that the their them then there these they
    this to too two up us was we were what when which while who will with would you your
    aber alle als am an auch auf aus bei bin bis das dass dem den der des die doch du durch ein eine einem einen einer es für haben hat ich ihr im ist
    ja kann man mehr mein mit nach nicht noch nur oder ohne sehr sein seine seit sich sie sind so um und uns viel von vor war was wenn wie wir wird wurde zu zum zur
    au aussi avec bien ce cet cette ces comme dans de des depuis du elle en encore est et eux il ils je la le les leur lui ma mais même mes mon ne nous
    on ou par pas peu plus pour qu quand que qui sa sans se ses si son sont sur ta te tes toi ton tout très tu un une vous y
    al algo así como con cuando cual de del desde donde el ella en entre era es esta este esto está ha hasta la las le lo los me mi muy más ni no nos
    o para pero poco por porque que qué se ser si sin sobre su sus también tan te tiene todo tu un una uno y ya""".split()
)
_FIELDS = ("chars", "letters", "digits", "odd", "tokens", "words", "word_chars", "common", "gaps", "tabs", "pipes", "marks", "hashes", "commas", "tight", "terms", "long", "repeats", "bares", "harsh", "other")
CHARS, LETTERS, DIGITS, ODD, TOKENS, WORDS, WORD_CHARS, COMMONS, GAPS, TABS, PIPES, MARKS, HASHES, COMMAS, TIGHT, TERMS, LONG, REPEATS, BARES, HARSH, OTHER = range(len(_FIELDS))
_N = len(_FIELDS)
KINDS = ("blank", "prose", "list", "table", "tags", "markup", "junk")
BLANK, PROSE, LIST, TABLE, TAGS, MARKUP, JUNK = range(len(KINDS))
#: What is added up for each kind of line.
_SUMMED = (CHARS, LETTERS, DIGITS, ODD, WORDS, WORD_CHARS, COMMONS)
_HEAD = 24
_BACK = 4

_COMMON_SIGNS = frozenset(" \t\r\x0b\x0c\xa0.,;:!?'\"()[]{}<>-–—_/\\&%+*=#@$€£°’‘“”„«»…|~^`¡¿·•")
_BULLET = re.compile(r"(?:[-*+•·▪◦‣●○■□–—✓✔➤►]|\(?\d{1,4}[.)]|\(?[a-zA-Z][.)]|\[[ xX]?\])\s")
_PAIR = re.compile(r"[\w ()./-]{1,24}?\s?[:=]\s?\S")
_STAMP = re.compile(r"\[?\d{4}-\d\d-\d\d|\d\d:\d\d:\d\d")
_TERMINAL = frozenset(".!?…。！？:\"'”»)")
_STOP, _SOFT_STOP, _QUOTE = ".!?…।؟", ".!?", "\"'”»)"
_VOWELS, _CONSONANTS = "aeiouyäöüáéíóúàèùâêîôûñçœæå", "bcdfghjklmnpqrstvwxz"

# Classes of characters, as bits.
_BITS = ("space", "impure", "alpha", "digit", "word", "letter", "odd", "mark", "vowel", "consonant", "rare", "after_rare", "other", "stop", "soft", "quote")
SPACE, IMPURE, ALPHA, DIGIT, WORDCHAR, LETTER, STRANGE, MARK, VOWEL, CONSONANT, RARE, AFTER_RARE, FOREIGN, STOP, SOFT, QUOTE = (1 << i for i in range(len(_BITS)))


def _class(c: str) -> int:
    low = c.lower()
    word = c.isalnum() or c == "_"
    letter = c.isalnum() and not c.isdecimal()
    # A mark that belongs to the spelling of its script, unlike accents piled on letters.
    spelled = c > "\u036f" and unicodedata.category(c) in ("Mn", "Mc")
    latin = "\u0041" <= c <= "\u02af" or "\u1e00" <= c <= "\u1eff" or "\uff21" <= c <= "\uff5a"
    told = (
        c.isspace(), c.isspace() and c not in " \xa0", c.isalpha(), c.isdigit(), word, letter, not (c.isalnum() or c.isspace() or c in _COMMON_SIGNS or spelled), c in '<>{}[]"',
        low in _VOWELS, low in _CONSONANTS, low in "jqvwx", low in "bcdfghjkmnpqtvwxz", letter and not latin, c in _STOP, c in _SOFT_STOP, c in _QUOTE,
    )
    return sum(1 << i for i, x in enumerate(told) if x)


def _lower(c: str) -> int:
    low = c.lower()
    return ord(low) if len(low) == 1 else ord(c)


_LOW = 0x2100
_CLASSES = np.array([_class(chr(i)) for i in range(_LOW)], np.uint16)
_LOWER = np.array([_lower(chr(i)) for i in range(_LOW)], np.uint32)
_POWERS = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(WORD)], np.uint64)


def _classified(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(classes, lower case) of code points; those beyond the table are looked up once each."""
    high = np.flatnonzero(codes >= _LOW)
    near = codes if not len(high) else np.minimum(codes, _LOW - 1)
    classes, lower = _CLASSES[near], _LOWER[near]
    if len(high):
        kinds, place = np.unique(codes[high], return_inverse=True)
        chars = [chr(k) for k in kinds.tolist()]
        classes[high] = np.array([_class(c) for c in chars], np.uint16)[place]
        lower[high] = np.array([_lower(c) for c in chars], np.uint32)[place]
    return classes, lower


def _word_hash(word: str) -> int:
    return sum(ord(c) * int(_POWERS[i]) for i, c in enumerate(word)) % (1 << 64)


_COMMON_HASHES = np.sort(np.array([_word_hash(w) for w in COMMON], np.uint64))


def _is_common(hashes: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(_COMMON_HASHES, hashes), len(_COMMON_HASHES) - 1)
    return _COMMON_HASHES[at] == hashes


def judge(n: np.ndarray, heads: list[str], lasts: list[str]) -> np.ndarray:
    """The kinds of whole lines from their counts, a row for each, their first characters and their last ones."""
    n = np.asarray(n, np.int64)
    kind = np.full(len(n), -1)
    chars, words, tokens, terms = n[:, CHARS], n[:, WORDS], n[:, TOKENS], n[:, TERMS]
    share = n[:, COMMONS] / np.maximum(words, 1)
    steps = np.maximum(n[:, BARES] - 1, 0)
    # The common words are of Latin script; a line of other script is told by its sentence ends or, without any, by its word lengths.
    other = (n[:, OTHER] * 2 > words) & (n[:, COMMAS] * 3 < words) & ((terms > 0) | (words >= 6) & (3 * words <= n[:, WORD_CHARS]) & (n[:, WORD_CHARS] <= 10 * words))

    def put(where: np.ndarray, what) -> None:
        where = where & (kind < 0)
        kind[where] = what[where] if isinstance(what, np.ndarray) else what

    def matching(pattern: re.Pattern, where: np.ndarray, end: str = "") -> np.ndarray:
        out = np.zeros(len(n), bool)
        for i in np.flatnonzero(where & (kind < 0)).tolist():
            out[i] = pattern.match(heads[i] + end) is not None
        return out

    put(chars == 0, BLANK)
    odd = (n[:, ODD] > 0.15 * chars) | (n[:, LETTERS] + n[:, DIGITS] < 0.5 * chars) & (words <= 12)
    put(odd, np.where(n[:, HASHES] > 1, TAGS, np.where(n[:, PIPES] > 1, TABLE, np.where(n[:, MARKS] > 3, MARKUP, JUNK))))
    put((steps >= 4) & (n[:, REPEATS] > 0.6 * steps), JUNK)
    put((words >= 4) & (n[:, HARSH] * 5 >= words * 2) & (share < 0.3), JUNK)
    bullet = matching(_BULLET, np.ones(len(n), bool), " ")
    # A bullet before a whole sentence is a dash of speech or a numbered paragraph, not a list item.
    sentence = (words >= 6) & ((share >= 0.15) | other) & (terms > 0) & np.array([c in ".!?…\"'”»" for c in lasts], bool)
    put(bullet, np.where(sentence, PROSE, LIST))
    put((n[:, MARKS] >= 4) & (n[:, MARKS] > 0.06 * chars) & (share < 0.25), MARKUP)
    put((n[:, HASHES] >= 2) & (n[:, HASHES] * 3 >= tokens), TAGS)
    put((n[:, PIPES] >= 2) | (n[:, TABS] >= 1) & (n[:, TABS] * 6 >= tokens) | (n[:, PIPES] > 0) & (share < 0.25), TABLE)
    put((n[:, GAPS] > 0) & (n[:, GAPS] * 8 >= tokens), TABLE)
    put(matching(_STAMP, share < 0.2), TABLE)
    put((n[:, TIGHT] >= 3) & (n[:, TIGHT] * 2 >= tokens), TABLE)
    put((n[:, LONG] > 0) & (n[:, LONG] * 4 >= tokens), JUNK)
    put(matching(_PAIR, (words <= 5) & (terms == 0) & np.array([c not in ".!?" for c in lasts], bool)), TABLE)
    put((words >= 4) & (n[:, COMMAS] * 3 >= words * 2) & (share < 0.25), TAGS)
    put(n[:, DIGITS] > 0.5 * chars, TABLE)
    put((words >= 4) & (share < 0.1) & ~other & ~((terms > 0) & (n[:, COMMAS] * 3 < words)), JUNK)
    put(kind < 0, PROSE)
    return kind


class Token:
    """A token that a cut goes through: length, its first two and last two characters, the characters before its first and after its last
    word character (length, if it has none), and whether it has letters and letters of another script."""

    def __init__(self, length, first, last, lead, trail, letter, other):
        self.state = (length, first, last, lead, trail, letter, other)

    def __add__(self, more: Token) -> Token:
        (n, a, z, lead, trail, letter, other), (m, b, y, lead2, trail2, letter2, other2) = self.state, more.state
        return Token(n + m, (a + b)[:2], (z + y)[-2:], lead if lead < n else n + lead2, trail2 if trail2 < m else m + trail, letter or letter2, other or other2)


class Fragment:
    """Counts of a stretch of one line and what its neighbours may change: n, the raw and the stripped beginning, the last character, the blanks
    at both ends (length, only blanks), the first four words with whether they repeat one before, the last four, and the cut tokens."""

    __slots__ = ("n", "raw", "head", "last", "before", "behind", "first", "back", "left", "right", "single")

    def __init__(self, n, raw="", head="", last="", before=(0, True), behind=(0, True), first=(), back=(), left=None, right=None, single=False):
        self.n, self.raw, self.head, self.last, self.before, self.behind = n, raw, head, last, before, behind
        self.first, self.back, self.left, self.right, self.single = list(first), list(back), left, right, single

    def __add__(self, more: Fragment) -> Fragment:
        n = [x + y for x, y in zip(self.n, more.n)]
        raw = (self.raw + more.raw)[:_HEAD]
        head = (self.head + more.raw)[:_HEAD] if self.last else more.head
        out = Fragment(n, raw, head, more.last or self.last)
        middle: list = []
        if self.right is not None and more.left is not None:
            token = self.right + more.left
            if self.right.state[2][-1:] == ",":
                n[TIGHT] += 1
            if self.single:
                out.left, out.single = token, more.single
                out.right = token if more.single else more.right
            elif more.single:
                out.left, out.right = self.left, token
            else:
                out.left, out.right = self.left, more.right
                middle = self._close(n, token)
            out.before, out.behind = self.before, more.behind
        else:
            out.left, out.right, out.single = self.left, more.right, self.single and not more.raw or more.single and not self.raw
            met = (min(_HEAD, self.behind[0] + more.before[0]), self.behind[1] and more.before[1])
            if self.last and more.last:
                n[GAPS] += int(met[0] >= 3 and met[1])
                out.before, out.behind = self.before, more.behind
            else:
                out.before, out.behind = (self.before if self.last else met), (more.behind if more.last else met)
        back = [*self.back, *middle]
        first = []
        for i, (h, repeats) in enumerate(more.first):
            if not repeats and h is not None and h in back[max(0, len(back) - (_BACK - i)) :]:
                n[REPEATS] += 1
                repeats = True
            first.append((h, repeats))
        out.first = [*self.first, *[(h, False) for h in middle], *first][:_BACK]
        out.back = [*back, *more.back][-_BACK:]
        return out

    @staticmethod
    def _close(n: list, token: Token) -> list:
        """Counts a cut token that has become whole; the word that it is, if it is one, equals no other."""
        length, first, last, lead, trail, letter, other = token.state
        n[TOKENS] += 1
        n[LONG] += 1
        n[HASHES] += int(first[0] == "#" and first[1:2].isalpha())
        n[TERMS] += int(last[-1] in _STOP or last[-2:-1] in tuple(_SOFT_STOP) and last[-1] in _QUOTE)
        if letter:
            n[WORDS] += 1
            n[WORD_CHARS] += length - lead - trail
            n[OTHER] += int(other)
        if lead == length:
            return []
        n[BARES] += 1
        return [None]

    def dump(self) -> tuple:
        return (self.n, self.raw, self.head, self.last, self.before, self.behind, self.first, self.back, self.left and self.left.state, self.right and self.right.state, self.single)

    @staticmethod
    def load(t: tuple) -> Fragment:
        return Fragment(*t[:8], t[8] and Token(*t[8]), t[9] and Token(*t[9]), t[10])


class Part:
    """Counts of a stretch of a document: open head and tail fragments and, between them, sums by kind of closed lines. tail is None
    as long as there is no line break."""

    def __init__(self, head: Fragment, tail: Fragment | None = None, sums: np.ndarray | None = None):
        self.head, self.tail, self.sums = head, tail, np.zeros((len(KINDS), 2 + len(_SUMMED)), np.int64) if sums is None else sums

    @staticmethod
    def _closed(sums: np.ndarray, lines: list[Fragment]) -> np.ndarray:
        out = sums.copy()
        kinds = judge(np.array([x.n for x in lines]), [x.head for x in lines], [x.last for x in lines])
        for x, kind in zip(lines, kinds.tolist()):
            out[kind] += [1, int(x.last in _TERMINAL), *[x.n[f] for f in _SUMMED]]
        return out

    def __add__(self, other: Part) -> Part:
        sums = self.sums + other.sums
        if self.tail is None:
            return Part(self.head + other.head, other.tail, sums)
        middle = self.tail + other.head
        if other.tail is None:
            return Part(self.head, middle, sums)
        return Part(self.head, other.tail, self._closed(sums, [middle]))

    def finish(self) -> np.ndarray:
        return self._closed(self.sums, [x for x in (self.head, self.tail) if x is not None])

    def dump(self) -> bytes:
        return marshal.dumps((self.head.dump(), self.tail and self.tail.dump(), self.sums.tolist()))

    @staticmethod
    def load(b: bytes) -> Part:
        head, tail, sums = marshal.loads(b)
        return Part(Fragment.load(head), tail and Fragment.load(tail), np.array(sums, np.int64))


def merge(parts: list[Part]) -> Part:
    """The sum of neighbouring parts, by halves."""
    while len(parts) > 1:
        parts = [parts[i] if i + 1 == len(parts) else parts[i] + parts[i + 1] for i in range(0, len(parts), 2)]
    return parts[0]


def cuts(text: str, piece: int, reach: int = REACH) -> list[int]:
    """Where the pieces of a text begin and, at last, its length."""
    blanks = re.compile(r"\S{0,%d}\s{0,%d}" % (reach, reach))
    out, at = [0], piece
    while at < len(text):
        end = blanks.match(text, at).end()
        if end >= len(text):
            break
        out.append(end)
        at = max(end, at) + piece
    return [*out, len(text)]


def count(pieces: list[tuple[str, bool, bool, bool]]) -> tuple[np.ndarray, list[Part | None]]:
    """(piece, whole, cut on the left, cut on the right) -> (sums by kind of the whole ones, parts of the others).

    whole: the piece is a document. A cut is one that goes through a token."""
    text = "\n".join([p[0] for p in pieces]) + "\n"
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    classes, lower = _classified(codes)
    ends = np.flatnonzero(codes == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    lines = len(ends)
    size = np.array([len(p[0]) for p in pieces], np.int64)
    begin = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    of_piece = np.searchsorted(begin, starts, "right") - 1

    n = np.zeros((lines, _N), np.int64)
    solid = (classes & SPACE) == 0
    for field, mask in ((CHARS, solid), (LETTERS, (classes & ALPHA) > 0), (DIGITS, (classes & DIGIT) > 0)):
        n[:, field] = np.add.reduceat(mask.view(np.uint8), starts, dtype=np.int64)

    def per_line(where: np.ndarray) -> np.ndarray:
        return np.bincount(np.searchsorted(starts, where, "right") - 1, minlength=lines)

    comma = codes == 44
    for field, mask in ((ODD, (classes & STRANGE) > 0), (MARKS, (classes & MARK) > 0), (TABS, codes == 9), (PIPES, codes == 124), (COMMAS, comma), (TIGHT, comma & np.append(solid[1:], False))):
        n[:, field] = per_line(np.flatnonzero(mask))

    edge = np.diff(np.concatenate([[0], solid.view(np.int8), [0]]))
    ts, te = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    line = np.searchsorted(starts, ts, "right") - 1
    word_at = np.flatnonzero(classes & WORDCHAR)
    lo, hi = np.searchsorted(word_at, ts), np.searchsorted(word_at, te)
    bare = hi > lo
    b0 = np.where(bare, np.append(word_at, 0)[np.minimum(lo, len(word_at))], te)
    b1 = np.where(bare, np.append(word_at, 0)[np.maximum(hi - 1, 0)] + 1, te)

    def holds(bit: int) -> np.ndarray:
        at = np.flatnonzero(classes & bit)
        return np.searchsorted(at, te) > np.searchsorted(at, ts)

    letter, foreign = holds(LETTER), holds(FOREIGN)
    cut_left, cut_right = np.zeros(len(ts), bool), np.zeros(len(ts), bool)
    open_left = [i for i, p in enumerate(pieces) if p[2] and p[0]]
    open_right = [i for i, p in enumerate(pieces) if p[3] and p[0]]
    cut_left[np.searchsorted(ts, begin[open_left])] = True
    cut_right[np.searchsorted(te, (begin + size)[open_right])] = True
    closed = ~(cut_left | cut_right)

    def tally(field: int, mask: np.ndarray, weight: np.ndarray | None = None) -> None:
        where = np.flatnonzero(mask & closed)
        n[:, field] += np.bincount(line[where], None if weight is None else weight[where], minlength=lines).astype(np.int64)

    length = te - ts
    last, second = classes[te - 1], np.where(length > 1, classes[np.maximum(te - 2, 0)], 0)
    every = np.ones(len(ts), bool)
    tally(TOKENS, every)
    tally(LONG, length > 25)
    tally(HASHES, (codes[ts] == 35) & (length > 1) & ((classes[np.minimum(ts + 1, len(codes) - 1)] & ALPHA) > 0))
    tally(TERMS, ((last & STOP) > 0) | ((second & SOFT) > 0) & ((last & QUOTE) > 0))
    tally(WORDS, letter)
    tally(WORD_CHARS, letter, b1 - b0)
    tally(BARES, bare)
    tally(OTHER, letter & foreign)

    # The words that are looked up: their characters side by side, with running sums of hashes.
    short = np.flatnonzero(bare & closed & (length <= WORD))
    size_w = (b1 - b0)[short]
    first = np.cumsum(size_w) - size_w
    owner = np.repeat(np.arange(len(short)), size_w)
    pos = np.arange(len(owner)) - first[owner]
    flat = b0[short][owner] + pos
    c, low = classes[flat], lower[flat]
    running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(low.astype(np.uint64) * _POWERS[pos], dtype=np.uint64)])
    hashes = running[first + size_w] - running[first]
    common = _is_common(hashes)
    mark = np.flatnonzero((low == 39) | (low == 8217))
    if len(mark):
        which, at = np.unique(owner[mark], return_index=True)
        common[which] |= _is_common(running[mark[at]] - running[first[which]])
    tally(COMMONS, _spread(common, short, len(ts)) & letter)
    consonant = (c & CONSONANT) > 0
    left = size_w[owner] - pos
    harsh = (size_w >= 3) & (np.bincount(owner[(c & VOWEL) > 0], minlength=len(short)) == 0)

    def follow(k: int) -> np.ndarray:
        """Where k consonants of one word begin."""
        run = consonant & (left >= k)
        for i in range(1, k):
            run[: max(0, len(run) - i)] &= consonant[i:]
        return run

    three = follow(3)
    four = follow(4)
    five = follow(5)
    q = np.flatnonzero((low == 113) & (left >= 2))
    rare = np.flatnonzero(((c & RARE) > 0) & (pos >= 1) & (left >= 2))
    for where in (np.flatnonzero(five), np.flatnonzero(three & (pos == 0)), np.flatnonzero(four & (left == 4)), q[low[q + 1] != 117] if len(q) else q, rare[(c[rare + 1] & AFTER_RARE) > 0] if len(rare) else rare):
        harsh[owner[where]] = True
    tally(HARSH, _spread(harsh & (size_w > 1), short, len(ts)) & letter & ~foreign)

    # Words in their order, for repeats; one that is too long to be looked up equals none.
    seq = np.flatnonzero(bare & closed)
    value = np.zeros(len(ts), np.uint64)
    value[short] = hashes
    known = np.zeros(len(ts), bool)
    known[short] = True
    v, ln, fine = value[seq], line[seq], known[seq]
    repeat = np.zeros(len(seq), bool)
    for back in range(1, _BACK + 1):
        if len(seq) > back:
            repeat[back:] |= (v[back:] == v[:-back]) & (ln[back:] == ln[:-back]) & fine[back:] & fine[:-back]
    n[:, REPEATS] = np.bincount(ln[repeat], minlength=lines)
    impure = np.flatnonzero((classes & IMPURE) > 0)
    if len(ts) > 1:
        wide = (line[1:] == line[:-1]) & (ts[1:] - te[:-1] >= 3)
        at = np.flatnonzero(wide)
        at = at[np.searchsorted(impure, ts[at + 1]) == np.searchsorted(impure, te[at])]
        n[:, GAPS] = np.bincount(line[at], minlength=lines)

    t0, t1 = np.searchsorted(line, np.arange(lines)), np.searchsorted(line, np.arange(lines), "right")
    filled = t1 > t0
    front = np.where(filled, np.append(ts, 0)[np.minimum(t0, len(ts))], ends)
    final = np.where(filled, np.append(te, 1)[np.maximum(t1 - 1, 0)] - 1, 0)
    heads = [text[a : min(a + _HEAD, b)] for a, b in zip(front.tolist(), ends.tolist())]
    lasts = [text[a] if f else "" for a, f in zip(final.tolist(), filled.tolist())]

    whole = np.array([p[1] for p in pieces], bool)
    edge_line = np.zeros(lines, bool)
    line0, line1 = np.searchsorted(of_piece, np.arange(len(pieces))), np.searchsorted(of_piece, np.arange(len(pieces)), "right") - 1
    edge_line[line0[~whole]] = edge_line[line1[~whole]] = True
    inner = np.flatnonzero(~edge_line)
    kinds = judge(n[inner], [heads[i] for i in inner], [lasts[i] for i in inner])
    cell = of_piece[inner] * len(KINDS) + kinds
    sums = np.zeros((len(pieces) * len(KINDS), 2 + len(_SUMMED)), np.int64)
    sums[:, 0] = np.bincount(cell, minlength=len(sums))
    sums[:, 1] = np.bincount(cell[[lasts[i] in _TERMINAL for i in inner]] if len(inner) else cell, minlength=len(sums))
    for i, field in enumerate(_SUMMED):
        sums[:, 2 + i] = np.bincount(cell, n[inner, field], minlength=len(sums)).astype(np.int64)
    sums = sums.reshape(len(pieces), len(KINDS), 2 + len(_SUMMED))

    def token(i: int) -> Token:
        a, b = int(ts[i]), int(te[i])
        return Token(b - a, text[a : min(b, a + 2)], text[max(a, b - 2) : b], int(b0[i]) - a if bare[i] else b - a, b - int(b1[i]) if bare[i] else b - a, bool(letter[i]), bool(letter[i] and foreign[i]))

    def blanks(a: int, b: int) -> tuple[int, bool]:
        return min(_HEAD, b - a), bool(np.searchsorted(impure, a) == np.searchsorted(impure, b))

    def fragment(i: int) -> Fragment:
        a, b, f = int(starts[i]), int(ends[i]), bool(filled[i])
        s, e = int(np.searchsorted(ln, i)), int(np.searchsorted(ln, i, "right"))
        word = lambda j: int(v[j]) if fine[j] else None
        out = Fragment(
            n[i].tolist(), text[a : min(a + _HEAD, b)], heads[i], lasts[i], blanks(a, int(front[i]) if f else b), blanks(int(final[i]) + 1 if f else a, b),
            [(word(j), bool(repeat[j])) for j in range(s, min(e, s + _BACK))], [word(j) for j in range(max(s, e - _BACK), e)],
        )
        if f:
            x, y = int(t0[i]), int(t1[i]) - 1
            out.left = token(x) if cut_left[x] else None
            out.right = token(y) if cut_right[y] else None
            out.single = out.left is not None and out.right is not None and x == y
        return out

    parts = [None if p[1] else Part(fragment(a), None if a == b else fragment(b), sums[i]) for i, (p, a, b) in enumerate(zip(pieces, line0.tolist(), line1.tolist()))]
    return sums, parts


def _spread(values: np.ndarray, where: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size, bool)
    out[where] = values
    return out


def cut_pieces(text: str, piece: int, reach: int = REACH) -> list[tuple[str, bool, bool, bool]]:
    at = cuts(text, piece, reach)
    if len(at) == 2:
        return [(text, True, False, False)]
    through = [False, *[not text[x - 1].isspace() and not text[x].isspace() for x in at[1:-1]], False]
    return [(text[a:b], False, through[i], through[i + 1]) for i, (a, b) in enumerate(zip(at, at[1:]))]


def count_texts(texts: list[str], piece: int = PIECE, reach: int = REACH) -> list[np.ndarray]:
    """Sums by kind of each text; a text of several pieces is merged from its parts."""
    out, held, size = [], [], 0

    def flush() -> None:
        sums, parts = count([p for one in held for p in one])
        at = 0
        for one in held:
            out.append(sums[at] if one[0][1] else merge(parts[at : at + len(one)]).finish())
            at += len(one)
        held.clear()

    for text in texts:
        held.append(cut_pieces(text, piece, reach))
        size += len(text)
        if size >= _BLOCK:
            flush()
            size = 0
    if held:
        flush()
    return out


_RATIOS = ("mean_word_length", "symbol_ratio", "terminal_share", "common_share", *[f"{k}_share" for k in KINDS[1:]])
_OUT = "doc_id long, n_chars long, n_lines long, n_words long, " + ", ".join(f"{k} double" for k in _RATIOS)


def ratios(sums: np.ndarray) -> list[np.ndarray]:
    """The statistics of documents, an array for each, from their sums (document, kind, what is summed)."""
    lines, terminal, chars, letters, digits, odd, words, word_chars, common = sums.sum(1).T
    lines = lines - sums[:, BLANK, 0]
    ratio = lambda a, b: np.where(b > 0, a / np.maximum(b, 1), 0.0)
    shares = [ratio(sums[:, kind, 2], chars) for kind in range(1, len(KINDS))]
    return [chars, lines, words, ratio(word_chars, words), ratio(chars - letters - digits, chars), ratio(terminal, lines), ratio(common, words), *shares]


_STATE = "doc_id long, key long, i int, last int, cut_left boolean, cut_right boolean, text string, part binary, sums array<long>"
_NAMES = [x.split(" ")[0] for x in _STATE.split(", ")]
_STATE_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.string(), pa.binary(), pa.list_(pa.int64())]


def _open(rows: list[tuple]) -> pa.RecordBatch:
    """Rows (doc_id, key, i, last, cut_left, cut_right, text, part) of documents that aren't whole yet."""
    columns = [*zip(*rows)] if rows else [()] * 8
    return pa.RecordBatch.from_arrays([*[pa.array(list(c), t) for c, t in zip(columns, _STATE_TYPES)], pa.nulls(len(rows), _STATE_TYPES[8])], _NAMES)


def _whole(ids: list[int], keys: list[int], sums: list[np.ndarray]) -> pa.RecordBatch:
    n = len(ids)
    width = len(KINDS) * (2 + len(_SUMMED))
    values = np.concatenate([x.ravel() for x in sums]) if n else np.empty(0, np.int64)
    told = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(values))
    zero, no = pa.array(np.zeros(n, np.int32)), pa.array(np.zeros(n, bool))
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), zero, zero, no, no, pa.nulls(n, pa.string()), pa.nulls(n, pa.binary()), told], _NAMES)


def quality(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", piece: int = PIECE, spread: int = SPREAD, reach: int = REACH) -> DataFrame:
    """One row for each document: counts, ratios, and the share of its characters (blanks don't count) in lines of each kind.

    mean_word_length, symbol_ratio (neither letter nor digit), terminal_share (lines that end in punctuation),
    common_share (function words), and prose_share, list_share, table_share, tags_share, markup_share, junk_share,
    which sum to 1. ``not_prose`` is true where prose_share < 0.5.

    Defined cases: a null id or a null or blank text gives no row; repeated rows give repeated rows where their ids
    differ, and one row for each id and text where they don't; an empty table gives none. Whole texts are read. A token of more than 64
    characters is counted with its length and letters, but is no common, harsh or repeated word.
    """
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), F.col(text).alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL AND text RLIKE '\\\\S'")
    tasks = shuffle_partitions(documents.sparkSession)

    def leaves(batches):
        """Sums of every document; of one that is spread, its stretches."""
        for batch in batches:
            ids, keys, texts = (batch.column(c).to_pylist() for c in range(3))
            small = [i for i, t in enumerate(texts) if len(t) <= spread]
            counted = count_texts([texts[i] for i in small], piece, reach)
            yield _whole([ids[i] for i in small], [keys[i] for i in small], counted)
            for i in sorted(set(range(len(texts))) - set(small)):
                stretches = cut_pieces(texts[i], spread, reach)
                yield _open([(ids[i], keys[i], at, len(stretches) - 1, left, right, t, None) for at, (t, _, left, right) in enumerate(stretches)])

    def stretch(t: str, left: bool, right: bool) -> Part:
        inner = cut_pieces(t, piece, reach)
        inner = [(p, False, left if i == 0 else a, right if i + 1 == len(inner) else b) for i, (p, _, a, b) in enumerate(inner)]
        return merge(count(inner)[1])

    def level(keep):
        """Rows sorted by (doc_id, key, i): sums pass, neighbouring parts of a document merge."""

        def run(batches):
            now, at, held, last, told = None, -1, [], 0, None
            for batch in batches:
                done = batch.filter(batch.column(8).is_valid())
                ids, keys = done.column(0).to_numpy(), done.column(1).to_numpy()
                fresh = np.ones(len(ids), bool)
                fresh[1:] = (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])
                if len(ids):
                    fresh[0] = (ids[0], keys[0]) != told
                    told = (ids[-1], keys[-1])
                yield done.filter(pa.array(fresh))
                rest = batch.filter(batch.column(8).is_null())
                for doc, key, i, end, left, right, t, part in zip(*[rest.column(c).to_pylist() for c in range(8)]):
                    group = (doc, key, i // FAN_IN if t is not None else 0)
                    if group == now and i == at:
                        continue  # the same document, sent twice
                    one = stretch(t, left, right) if t is not None else Part.load(part)
                    if group != now:
                        if now is not None:
                            yield keep(now, at, last, merge(held))
                        now, held, last = group, [], end
                    held.append(one)
                    at = i
            if now is not None:
                yield keep(now, at, last, merge(held))

        return run

    inner = level(lambda now, at, last, part: _open([(now[0], now[1], at, last, False, False, None, part.dump())]))
    root = level(lambda now, at, last, part: _whole([now[0]], [now[1]], [part.finish()]))
    order = ("doc_id", "key", "i")
    node = F.when(F.col("sums").isNull(), F.floor(F.col("i") / FAN_IN)).otherwise(0)
    tree = docs.mapInArrow(leaves, _STATE).repartition(tasks, "doc_id", "key", node).sortWithinPartitions(*order).mapInArrow(inner, _STATE)
    tree = tree.repartition(tasks, "doc_id", "key").sortWithinPartitions(*order).mapInArrow(root, _STATE)
    names = [x.split(" ")[0] for x in _OUT.split(", ")]

    def finish(batches):
        for batch in batches:
            counts = ratios(batch.column(8).flatten().to_numpy().reshape(batch.num_rows, len(KINDS), 2 + len(_SUMMED)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, counts)], names)

    return tree.mapInArrow(finish, _OUT).withColumn("not_prose", F.col("prose_share") < 0.5)
