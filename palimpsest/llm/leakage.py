"""Evaluation texts inside training pages, through rare n-gram seeds and Smith-Waterman alignment.

Pages are scanned: letters are misread, words are broken at line ends, columns
are read in turn. So a page is cut into pieces (lines, or the columns of a line),
and pieces are compared as runs of letters and digits with often confused
characters folded. Rare character n-grams of the items (rare: among the less
frequent half of their neighbourhood by document frequency, counted over the
whole corpus, and in few items), and in every run of words that could leak the
rarest there are, seed candidate pieces; each is aligned to every
item that has enough seeds on the page, however many more another item has, by banded Smith-Waterman; aligned pieces that follow each other in the item,
whatever stands between them on the page, are chained; the longest run of
item words that the chain carries decides.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a seed, items that the rare seeds may stand in, seeds a page and an item share at least.
GRAM, SEED_ITEMS, SEEDS = 7, 16, 2
#: Seeds that every run of RUN_WORDS item words has at least, if it has as many n-grams, whatever their frequency.
WINDOW_SEEDS = 24
#: Items that are broadcast at once; more are worked off in blocks.
ITEM_BLOCK = 2_000
#: Consecutive item words that make a leak.
RUN_WORDS = 12
#: Half width of the alignment band, longest piece part aligned at once, pieces that may lie between two of a chain.
BAND, PART, REACH = 6, 64, 10
#: Score an aligned part has at least; characters it spans at least to look for its neighbours.
LEAST_SCORE, LEAST_SPAN = 8, 12
#: Item characters that may be missing between, or shared by, two chained pieces.
SLACK = 8
#: Characters of a part that may stand unmatched before or after what it passes on.
EDGE = 3

# Scanned characters that are often read for another, by what they are folded to.
FOLDS = {"i": "l1!|ij", "o": "0oø°", "s": "5sſ", "c": "c(", "t": "t+", "b": "6b8", "z": "2z"}

_BREAK = 1
_P = np.uint64(0x9E3779B97F4A7C15)
#: Code points with a folding of their own; letters beyond are folded one by one.
_TABLED = 0x2500


def _is_single(cp: int) -> bool:
    """Whether a character of a script without blanks is a word by itself."""
    return 0x3040 <= cp <= 0x30FF or 0x3400 <= cp <= 0x9FFF or 0xF900 <= cp <= 0xFAFF or 0x20000 <= cp <= 0x3FFFF or 0xE00 <= cp <= 0xEFF


def _folding() -> tuple[np.ndarray, np.ndarray]:
    """For each code point below ``_TABLED``: its folded letter code (0: no letter or digit, 1: line break), and whether it is a digit."""
    to = {c: k for k, cs in FOLDS.items() for c in cs}
    table, digit = np.zeros(_TABLED, np.uint16), np.zeros(_TABLED, bool)
    codes: dict[str, int] = {}
    for cp in range(_TABLED):
        ch = chr(cp).lower()[:1]
        ch = to.get(ch) or unicodedata.normalize("NFD", ch)[:1]
        ch = to.get(ch, ch)
        if ch.isalnum():
            table[cp] = codes.setdefault(ch, 3 + len(codes))
            digit[cp] = chr(cp).isdigit()
    for cp in (0x0A, 0x0D, 0x0B, 0x0C, 0x85, 0x2028, 0x2029):
        table[cp] = _BREAK
    return table, digit


_TABLE, _DIGIT = _folding()
_FIRST_FREE = int(_TABLE.max()) + 1


def _fold_high(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for any code points; letters beyond the table have codes by their own number."""
    low = codes < _TABLED
    cls, digit = _TABLE[np.where(low, codes, 0)], _DIGIT[np.where(low, codes, 0)]
    high = np.flatnonzero(~low)
    kinds, at = np.unique(codes[high], return_inverse=True)
    letters = [chr(int(c)).lower() for c in kinds]
    cls[high] = np.array([_FIRST_FREE + ord(c[0]) % (65_521 - _FIRST_FREE) if c[:1].isalnum() else 0 for c in letters], np.uint16)[at]
    digit[high] = np.array([c.isdigit() for c in letters], bool)[at]
    return cls, digit


@dataclass
class Folded:
    """Folded characters of many texts, back to back."""

    char: np.ndarray
    digit: np.ndarray
    joined: np.ndarray  # no blank or sign stands before this character, and it is no word by itself
    piece: np.ndarray
    page: np.ndarray


def fold(texts: list[str | None]) -> Folded:
    """Letters and digits of all texts with the piece and the text they stand in; signs written as one for several letters are taken apart."""
    texts = ["" if t is None else t if t.isascii() or max(t) < chr(_TABLED) else unicodedata.normalize("NFKC", t) for t in texts]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    every = len(codes) == 0 or int(codes.max()) < _TABLED
    cls, digit = (_TABLE[codes], _DIGIT[codes]) if every else _fold_high(codes)
    page = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    turn = np.r_[False, page[1:] != page[:-1]] if len(page) else np.empty(0, bool)
    if len(codes) >= 3:
        blank = codes == 32
        gap = blank[:-2] & blank[1:-1] & blank[2:]
        cls[:-2][gap] = _BREAK
    piece = np.cumsum((cls == _BREAK) | turn)
    at = np.flatnonzero(cls > _BREAK)
    joined = np.r_[False, (np.diff(at) == 1) & ~turn[at[1:]]] if len(at) else np.empty(0, bool)
    if not every:
        single = np.isin(codes[at], [c for c in np.unique(codes[at]) if _is_single(int(c))])
        joined &= ~single & ~np.r_[False, single[:-1]]
    return Folded(cls[at], digit[at], joined, piece[at], page[at])


def gram_hashes(char: np.ndarray, group: np.ndarray, k: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Start positions and hashes of all k-grams that stay inside one group."""
    n = len(char) - k + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            h = h * _P + char[j : j + n]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
    at = np.flatnonzero(group[:n] == group[k - 1 :])
    return at, h[at]


class Items:
    """Items of one block: folded characters, their words, and the n-gram table."""

    def __init__(self, ids: list, texts: list[str]):
        self.ids = ids
        f = fold(texts)
        self.char, self.item = f.char, f.page
        self.start = np.searchsorted(self.item, np.arange(len(ids) + 1))
        self.digit = f.digit
        # words, as the item has them: runs of letters and digits without anything between
        self.word = np.cumsum(~f.joined | np.r_[True, np.diff(f.page) != 0]) - 1 if len(f.char) else np.empty(0, np.int64)
        self.pos, h = gram_hashes(self.char, self.item)
        self.keys, self.inv = np.unique(h, return_inverse=True)
        self.kept = np.ones(len(self.pos), bool)
        self._index()

    def _index(self) -> None:
        keep = np.flatnonzero(self.kept)
        order = keep[np.argsort(self.inv[keep], kind="stable")]
        self.post = self.pos[order]
        self.post_at = np.searchsorted(self.inv[order], np.arange(len(self.keys) + 1))
        self.filter = np.zeros(1 << 21, bool)
        if len(self.keys):
            self.filter[(self.keys >> np.uint64(43)).astype(np.int64)] = True

    def least_chars(self, words: int) -> np.ndarray:
        """For each item, the characters that must be in place for ``words`` consecutive words to be read."""
        out = np.full(len(self.ids), np.inf)
        for i in range(len(self.ids)):
            w = self.word[self.start[i] : self.start[i + 1]]
            if len(w):
                sizes = np.r_[0, np.cumsum(np.bincount(w - w[0]))]
                if len(sizes) > words:
                    out[i] = 0.55 * (sizes[words:] - sizes[:-words]).min()
        return out

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are in the table, and where."""
        if not len(self.keys):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        maybe = np.flatnonzero(self.filter[(h >> np.uint64(43)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, h[maybe]), len(self.keys) - 1)
        hit = self.keys[at] == h[maybe]
        return maybe[hit], at[hit]

    def choose(self, df: np.ndarray, spread: np.ndarray | None = None, run_words: int = RUN_WORDS) -> None:
        """Keep, around every position, the half of the n-grams that fewer pages have, of those that few items share; and the rarest of every ``run_words`` words.

        ``spread`` tells in how many items each n-gram stands, if there are others than these.
        """
        if spread is None:
            pairs = np.unique(np.stack([self.inv, self.item[self.pos]]), axis=1) if len(self.pos) else np.empty((2, 0), np.int64)
            spread = np.bincount(pairs[0], minlength=len(self.keys))
        pages = df[self.inv]
        cost = np.where(spread[self.inv] <= SEED_ITEMS, pages, np.iinfo(np.int64).max)
        kept = np.zeros(len(self.pos), bool)
        for i in range(len(self.ids)):
            lo, hi = np.searchsorted(self.item[self.pos], [i, i + 1])
            for a in range(lo, hi, 12):
                b = min(hi, a + 36)
                part = cost[a:b]
                kept[a:b] |= (part <= np.median(part)) & (part < np.iinfo(np.int64).max)
            word, first = self.word[self.start[i] : self.start[i + 1]], int(self.start[i])
            begin = first + np.flatnonzero(np.r_[True, np.diff(word) != 0]) if len(word) else np.empty(0, np.int64)
            end = np.r_[begin[1:], self.start[i + 1]]
            from_, to = np.searchsorted(self.pos[lo:hi], begin) + lo, np.searchsorted(self.pos[lo:hi], end - GRAM, "right") + lo
            for a, b in zip(from_[: len(begin) - run_words + 1], to[run_words - 1 :]):
                short = WINDOW_SEEDS - int(kept[a:b].sum())
                if short > 0:
                    rest = a + np.flatnonzero(~kept[a:b])
                    kept[rest[np.argsort(pages[rest], kind="stable")[:short]]] = True
        self.kept = kept
        self._index()


def document_frequency(docs: DataFrame, text: str, items: Items) -> np.ndarray:
    """In how many pages of the whole corpus each n-gram of the items stands; as many numbers as the items have n-grams."""
    kept = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it = kept.value
        total = np.zeros(len(it.keys), np.int64)
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                f = fold(b.column(0).slice(lo, 1000).to_pylist())
                at, h = gram_hashes(f.char, f.piece)
                which, gram = it.find(h)
                seen = np.unique(f.page[at[which]].astype(np.int64) * len(it.keys) + gram)
                total += np.bincount(seen % max(1, len(it.keys)), minlength=len(it.keys))
        got = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(got, pa.int64()), pa.array(total[got], pa.int64())], names=["gram", "n"])

    df = np.zeros(len(items.keys), np.int64)
    counted = docs.select(text).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    df[np.asarray(counted.column(0).combine_chunks())] = np.asarray(counted.column(1).combine_chunks())
    return df


def smith_waterman(a: np.ndarray, a_len: np.ndarray, b: np.ndarray, band: int = BAND, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Banded local alignment of many pairs: match 2, mismatch -1, gap -2.

    ``a`` is padded to a width L with 0, ``b`` to L + 2 * band with 1; cell (i, d)
    compares ``a[i]`` with ``b[i + d]``. Returns the score, and for every
    character of ``a`` the column of ``b`` it is matched with (equal), or -1;
    pairs of a score under ``least`` are not traced back.
    """
    n, width = a.shape
    w = 2 * band + 1
    order = np.argsort(a_len, kind="stable")  # of pairs by length, those that still go on are a slice
    ended = np.searchsorted(a_len[order], np.arange(width), "right").tolist()
    a, b = (np.ascontiguousarray(x[order].T.astype(np.uint16, copy=False)) for x in (a, b))
    h = np.zeros((width + 1, w + 2, n), np.int16)  # a row of zeros on either side of the band
    best, best_i = np.zeros(n, np.int16), np.zeros(n, np.int64)
    differ, less = np.empty((w, n), np.uint16), np.empty((w, n), np.int16)
    one, two, three, none = np.uint16(1), np.int16(2), np.int16(3), np.int16(0)
    for i in range(width):
        c = ended[i]
        if c == n:
            break
        cur, x, y = h[i + 1, 1:-1, c:], differ[:, c:], less[:, c:]
        np.bitwise_xor(b[i : i + w, c:], a[i, c:], out=x)
        np.minimum(x, one, out=x)
        np.multiply(x.view(np.int16), three, out=y)
        np.subtract(h[i, 1:-1, c:], y, out=cur)
        cur += two
        np.subtract(h[i, 2:, c:], two, out=y)
        np.maximum(cur, y, out=cur)
        np.maximum(cur, none, out=cur)
        k = 1
        while k < w:  # gaps of up to 1, 3, 7 and so on
            np.subtract(cur[:-k], np.int16(2 * k), out=y[k:])
            np.maximum(cur[k:], y[k:], out=cur[k:])
            k *= 2
        top = cur.max(0)
        np.copyto(best_i[c:], i, where=top > best[c:])
        np.maximum(best[c:], top, out=best[c:])
    match = np.full((n, width), -1, np.int64)
    live = np.flatnonzero(best >= max(1, least))
    i, d = best_i[live], h[best_i[live] + 1, 1:-1, live].argmax(1)
    cells, chars, others, out = h.reshape(-1), a.reshape(-1), b.reshape(-1), match.reshape(-1)
    row = (w + 2) * n
    at = (i + 1) * row + (d + 1) * n + live
    here = cells[at]
    while len(live):
        equal = chars[i * n + live] == others[(i + d) * n + live]
        before = cells[at - row]
        diag = here == before + np.where(equal, two, np.int16(-1))
        above = cells[at - row + n]
        up = ~diag & (here == above - two)
        hit = np.flatnonzero(diag & equal)
        out[order[live[hit]] * width + i[hit]] = i[hit] + d[hit]
        left = ~diag & ~up
        here = np.where(diag, before, np.where(up, above, cells[at - n]))
        i = i - ~left
        d = d + up - left
        at = at + np.where(diag, -row, np.where(up, n - row, -n))
        on = np.flatnonzero((here > 0) & (i >= 0) & (d >= 0) & (d < w))
        live, i, d, at, here = live[on], i[on], d[on], at[on], here[on]
    score = np.empty_like(best)
    score[order] = best
    return score, match


class _Parts:
    """Aligned parts: their pair, piece, place, the item positions ``lo`` to ``hi`` they are matched with, and whether they are matched from and to their edges."""

    def __init__(self) -> None:
        self.where: list[np.ndarray] = []
        self.columns = {k: np.empty(0, np.int64) for k in ("pair", "piece", "begin", "size", "lo", "hi", "n", "from_edge", "to_edge")}

    def add(self, where: list[np.ndarray], **columns: np.ndarray) -> None:
        self.where.extend(where)
        self.columns = {k: np.concatenate([v, columns[k]]) for k, v in self.columns.items()}

    def __getattr__(self, name: str) -> np.ndarray:
        return self.columns[name]


def _align(it: Items, f: Folded, parts: _Parts, pair: np.ndarray, piece: np.ndarray, begin: np.ndarray, size: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Align piece parts to their items at ``offset`` (item position of the part's first character); what matches is added, its pairs are returned."""
    item = pair % len(it.ids)
    width = int(min(PART, size.max()))
    cols = np.arange(width)
    inside = cols[None, :] < size[:, None]
    a = np.where(inside, f.char[np.minimum(begin[:, None] + cols, len(f.char) - 1)], np.uint16(0))
    bcols = offset[:, None] - BAND + np.arange(width + 2 * BAND)[None, :]
    there = (bcols >= it.start[item][:, None]) & (bcols < it.start[item + 1][:, None])
    b = np.where(there, it.char[np.clip(bcols, 0, len(it.char) - 1)], np.uint16(1))
    score, match = smith_waterman(a, size, b, least=LEAST_SCORE)
    hit = match >= 0
    n = hit.sum(1)
    good = np.flatnonzero((score >= LEAST_SCORE) & (n >= 5))
    hit, where = hit[good], np.where(hit[good], match[good] + (offset[good] - BAND)[:, None], -1)
    first, last = hit.argmax(1), width - 1 - hit[:, ::-1].argmax(1)
    rows = np.arange(len(good))
    parts.add(
        list(where), pair=pair[good], piece=piece[good], begin=begin[good], size=size[good], lo=where[rows, first], hi=where[rows, last] + 1, n=n[good],
        from_edge=(first <= EDGE).astype(np.int64), to_edge=(size[good] - 1 - last <= EDGE).astype(np.int64),
    )
    return pair[good]


def _longest_run(it: Items, i: int, rows: np.ndarray, parts: _Parts, f: Folded, least: float) -> int:
    """The most consecutive item words that one chain of parts carries.

    A chain goes on only from the end of a part to the beginning of another;
    chains of fewer than ``least`` matched characters are passed over.
    """
    lo = int(it.start[i])
    hi = int(it.start[i + 1])
    rows = rows[np.lexsort((parts.begin[rows], parts.piece[rows]))]
    piece, start, end, count, from_, to = (parts.columns[c][rows].tolist() for c in ("piece", "lo", "hi", "n", "from_edge", "to_edge"))
    if sum(count) < least:
        return 0
    after = [t for t in range(len(rows)) if from_[t]]  # what a chain may go on with
    word = it.word[lo:hi]
    first_word = int(word[0])
    n_words = int(word[-1]) - first_word + 1
    sizes = numbers = None
    best = 0
    used = [False] * len(rows)
    for s in range(len(rows)):
        if used[s]:
            continue
        chain, last = [s], s
        while to[last]:
            most, low, high = piece[last] + REACH, end[last] - SLACK, end[last] + SLACK
            for t in after[bisect_right(after, last) :]:
                if piece[t] > most:
                    t = None
                    break
                if low <= start[t] <= high and not used[t] and end[t] > end[last]:
                    break
            else:
                t = None
            if t is None:
                break
            used[t] = True
            chain.append(t)
            last = t
        if sum(count[c] for c in chain) < least:
            continue
        if sizes is None:
            sizes = np.bincount(word - first_word, minlength=n_words)
            numbers = np.bincount(word - first_word, it.digit[lo:hi], minlength=n_words) > 0
        held = np.zeros(hi - lo, bool)
        foreign = np.zeros(n_words, bool)
        for c in chain:
            begin, where = int(parts.begin[rows[c]]), parts.where[rows[c]]
            m = np.flatnonzero(where >= 0)
            held[where[m] - lo] = True
            # digits that stand right beside a number on the page make it another number
            for x in m[it.digit[where[m]]]:
                at, w = begin + x, int(word[where[x] - lo]) - first_word
                for near, glue in ((at - 1, at), (at + 1, at + 1)):
                    if 0 <= near < len(f.char) and glue < len(f.char) and f.joined[glue] and f.digit[near] and f.piece[near] == f.piece[at]:
                        k = near - begin
                        if not (0 <= k < len(where) and where[k] >= 0):
                            foreign[w] = True
        got = np.bincount(word - first_word, held, minlength=n_words)
        # half of a short word, or a short word between two that are read, stands in the place of misread letters
        ok = np.where(numbers, got == sizes, np.where(sizes <= 3, 2 * got >= sizes, 5 * got >= 3 * sizes)) & ~foreign
        between = np.zeros_like(ok)
        between[1:-1] = ok[:-2] & ok[2:] & (sizes[1:-1] <= 3) & ~numbers[1:-1]
        run = 0
        for x in (ok | between).tolist():
            run = run + 1 if x else 0
            best = max(best, run)
    return best


@dataclass
class _Reach:
    """Of pairs (sorted): whether what their parts cover together is half of what a run needs, and all of it; of parts, whether the passage may go on before and after."""

    pairs: np.ndarray
    half: np.ndarray
    full: np.ndarray
    ahead: np.ndarray
    behind: np.ndarray


def _reach(it: Items, parts: _Parts, rows: np.ndarray, least: np.ndarray, run_words: int) -> _Reach:
    """Item stretches that the parts ``rows`` of each pair cover without a gap of more than SLACK."""
    pairs, p = np.unique(parts.pair[rows], return_inverse=True)
    item = pairs % len(it.ids)
    apart = np.int64(len(it.char) + 4 * SLACK)
    lo, hi = parts.lo[rows] + p * apart, parts.hi[rows] + p * apart
    order = np.lexsort((hi, lo))
    a, b, q = lo[order], hi[order], p[order]
    before = np.r_[np.int64(-apart), np.maximum.accumulate(b)[:-1]]
    new = a > before + SLACK
    begin = np.flatnonzero(new)
    size = np.add.reduceat(np.where(new, b - a, np.maximum(0, b - np.maximum(a, before))), begin)
    of = q[begin]
    words = it.word[np.maximum.reduceat(b, begin) - of * apart - 1] - it.word[a[begin] - of * apart] + 1
    half, full = np.zeros(len(pairs), bool), np.zeros(len(pairs), bool)
    half[of[size >= 0.5 * least[item[of]]]] = True
    full[of[(size >= least[item[of]]) & (words >= run_words)]] = True  # a run lies in one stretch
    starts, ends = np.sort(lo), np.sort(hi)
    none = lambda at, x: np.searchsorted(at, x - SLACK) == np.searchsorted(at, x + SLACK, "right")
    long = parts.hi[rows] - parts.lo[rows] >= LEAST_SPAN
    ahead = long & (parts.to_edge[rows] > 0) & (parts.hi[rows] < it.start[item[p] + 1] - 2) & none(starts, hi)
    behind = long & (parts.from_edge[rows] > 0) & (parts.lo[rows] > it.start[item[p]] + 2) & none(ends, lo)
    return _Reach(pairs, half, full, ahead, behind)


def leaks_in(it: Items, texts: list[str | None], run_words: int = RUN_WORDS) -> list[tuple[int, int, int]]:
    """(page, item, longest run of item words) of all pages of a batch that carry at least ``run_words`` consecutive words."""
    f = fold(texts)
    at, h = gram_hashes(f.char, f.piece)
    which, gram = it.find(h)
    count = it.post_at[gram + 1] - it.post_at[gram]
    if not count.sum():
        return []
    src = np.repeat(at[which], count)
    post = it.post[np.repeat(it.post_at[gram], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
    pair = f.page[src].astype(np.int64) * len(it.ids) + it.item[post]
    _, inverse, hits = np.unique(pair, return_inverse=True, return_counts=True)
    keep = hits[inverse] >= SEEDS
    src, post, pair = src[keep], post[keep], pair[keep]
    if not len(src):
        return []
    # parts of pieces: long pieces are cut every PART characters
    piece_start = np.flatnonzero(np.r_[True, np.diff(f.piece) != 0])
    piece_of = np.searchsorted(piece_start, np.arange(len(f.char)), "right") - 1
    piece_end = np.r_[piece_start[1:], len(f.char)]
    piece_page = f.page[piece_start]
    part_begin = piece_start[piece_of[src]] + (src - piece_start[piece_of[src]]) // PART * PART
    # the offset most seeds of a part agree on
    offset = post - (src - part_begin)
    order = np.lexsort((offset, part_begin, pair))
    key = np.stack([pair[order], part_begin[order], offset[order]])
    first = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(0)])
    votes, key = np.diff(np.r_[first, key.shape[1]]), key[:, first]
    order = np.lexsort((-votes, key[1], key[0]))
    key = key[:, order]
    pair, begin, offset = key[:, np.flatnonzero(np.r_[True, (np.diff(key[0]) != 0) | (np.diff(key[1]) != 0)])]
    parts = _Parts()
    pairs = np.unique(pair)
    tried = np.empty(0, np.int64), np.empty(0, np.int64)  # places, and the offsets they were aligned at
    result: dict[int, int] = {}
    least = it.least_chars(run_words)
    while len(pair):  # ends: no place is tried twice with one offset
        size = np.minimum(piece_end[piece_of[begin]] - begin, PART)
        order = np.argsort(size, kind="stable")  # parts of like length are padded little
        pair, begin, offset, size = pair[order], begin[order], offset[order], size[order]
        touched = [_align(it, f, parts, pair[lo : lo + 2048], piece_of[begin[lo : lo + 2048]], begin[lo : lo + 2048], size[lo : lo + 2048], offset[lo : lo + 2048]) for lo in range(0, len(pair), 2048)]
        rows = np.flatnonzero(np.isin(parts.pair, np.unique(np.concatenate(touched))))
        if not len(rows):
            break
        rows = rows[np.argsort(parts.pair[rows], kind="stable")]
        r = _reach(it, parts, rows, least, run_words)
        bounds = np.searchsorted(parts.pair[rows], r.pairs)
        bounds = np.r_[bounds, len(rows)]
        open_ = r.half.copy()
        for k in np.flatnonzero(r.full):
            p = int(r.pairs[k])
            run = _longest_run(it, p % len(it.ids), rows[bounds[k] : bounds[k + 1]], parts, f, least[p % len(it.ids)])
            result[p] = max(run, result.get(p, 0))
            open_[k] = run < run_words
        on = np.repeat(open_, np.diff(bounds))
        x = rows[on & (r.ahead | r.behind)]
        ahead, behind = r.ahead[on & (r.ahead | r.behind)], r.behind[on & (r.ahead | r.behind)]
        p, q0, b, lo, hi = (parts.columns[c][x] for c in ("pair", "piece", "begin", "lo", "hi"))
        more = ahead & (b + PART < piece_end[q0])
        steps = np.r_[np.arange(1, REACH + 1), -np.arange(1, REACH + 1)]
        q = q0[:, None] + steps
        there = (q >= 0) & (q < len(piece_start)) & np.where(steps > 0, (ahead & ~more)[:, None], behind[:, None])
        q = np.where(there, q, 0)
        n = piece_end[q] - piece_start[q]
        there &= (piece_page[q] == (p // len(it.ids))[:, None]) & ((steps > 0) | (n <= PART))
        k, j = np.nonzero(there)
        p, y, offset, far = (
            np.r_[u, v] for u, v in ((p[more], p[k]), (b[more] + PART, piece_start[q[k, j]]), (hi[more], np.where(j < REACH, hi[k], lo[k] - n[k, j])), (0 * b[more], np.abs(steps[j])))
        )
        first = np.argsort(np.r_[np.flatnonzero(more), k], kind="stable")  # part by part
        p, y, offset, far = p[first], y[first], offset[first], far[first]
        place = np.searchsorted(pairs, p) * np.int64(len(f.char) + 1) + y
        fresh = ~np.isin(place, np.searchsorted(pairs, parts.pair) * np.int64(len(f.char) + 1) + parts.begin)
        if len(tried[0]):
            _, code = np.unique(np.r_[tried[0], place], return_inverse=True)
            code = code * np.int64(len(it.char) + 4 * PART) + np.r_[tried[1], offset] + 2 * PART
            fresh &= ~np.isin(code[len(tried[0]) :], code[: len(tried[0])])
        fresh = np.flatnonzero(fresh)
        # of a place that several parts point to, the nearest part's offset
        fresh = fresh[np.lexsort((far[fresh], place[fresh]))]
        fresh = fresh[np.r_[True, np.diff(place[fresh]) != 0]] if len(fresh) else fresh
        tried = np.r_[tried[0], place[fresh]], np.r_[tried[1], offset[fresh]]
        pair, begin, offset = p[fresh], y[fresh], offset[fresh]
    return [(p // len(it.ids), p % len(it.ids), run) for p, run in result.items() if run >= run_words]


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", run_words: int = RUN_WORDS) -> DataFrame:
    """``id_col, item_id, run_words``: pages that carry at least ``run_words`` consecutive words of an item.

    The reported run is as long as was needed to decide, or longer.

    Letter case, punctuation, misread letters, broken words and pieces of other
    columns or adverts in between do not interrupt a run; another number does. A
    word counts as read if three in five of its letters are in place (half of a
    short one), a number only if all are. Null and empty texts and items have no leaks; an item of
    fewer than ``run_words`` words cannot leak. Repeated pages are reported each.
    Items are broadcast in blocks of a fixed number.
    """
    rows = items.where(F.col(item_id).isNotNull() & (F.length(item_text) > 0)).select(item_id, item_text)
    page_type = docs.schema[id_col].dataType.simpleString()
    item_type = items.schema[item_id].dataType.simpleString()
    shape = f"`{id_col}` {page_type}, `{item_id}` {item_type}, run_words long"
    total = rows.count()
    blocks = max(1, -(-total // ITEM_BLOCK))
    out = None
    for n in range(blocks):
        mine = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64(item_id), F.lit(blocks)) == n)
        got = mine.toArrow()
        block = Items(got.column(0).to_pylist(), got.column(1).to_pylist())
        spread = None if blocks == 1 else document_frequency(rows, item_text, block)
        block.choose(document_frequency(docs, text, block), spread, run_words)
        found = _found(docs.select(id_col, text), block, shape, [id_col, item_id, "run_words"], run_words)
        out = found if out is None else out.unionByName(found)
    return out


def _found(docs: DataFrame, block: Items, shape: str, names: list[str], run_words: int) -> DataFrame:
    kept = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it = kept.value
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                got = leaks_in(it, part.column(1).to_pylist(), run_words)
                pages = part.column(0).take(pa.array([g[0] for g in got], pa.int64()))
                yield pa.RecordBatch.from_arrays([pages, pa.array([it.ids[g[1]] for g in got]), pa.array([g[2] for g in got], pa.int64())] if got else [pages, pages.slice(0, 0).cast(pa.int64()), pa.array([], pa.int64())], names=names)

    return docs.mapInArrow(run, shape)
