"""Languages of pages and of their passages, by character language models.

For every language that the labels name often enough an interpolated Kneser-Ney
model of character 5-grams is fitted on a bounded sample of labelled pages,
refitted without the lines that another language's model explains better. A
label that does not explain held-out pages of its own is no language. All languages share one sorted hash
array per order, with one column of log-probabilities a language, so that a
character costs a few binary searches for all languages together. Words are
scored once a worker. A line gets the language of the lowest length-normalised
cross-entropy, weighed with the page's own mixture of languages; confidences are
calibrated on held-out pages, and text that no model explains, be it a page or
a stretch of one, is rejected.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ORDER = 5
#: Most labelled pages a language's model is fitted on.
FIT_PAGES = 300
#: Words a passage has at least, and lines of other text in its own column, adverts set off by marks not counted, that may interrupt it.
PASSAGE_WORDS, PASSAGE_GAP = 30, 6
#: Share of correctly labelled training lines that the rejection may turn away.
REJECT_SHARE = 0.001
#: Code of text that no language explains.
UNKNOWN = "und"
#: Scored words a worker keeps before it starts anew.
CACHE_WORDS = 400_000

#: Labelled pages a language needs, and share of its held-out lines that its model must explain best.
LEAST_PAGES, OWN_SHARE = 10, 0.5
#: Characters of a line that can be rejected by itself.
REJECT_CHARS = 12

# Three-letter codes of libraries, where they differ from the standard's own.
LIBRARY_CODES = {
    "alb": "sq", "arm": "hy", "baq": "eu", "bur": "my", "chi": "zh", "cze": "cs", "dut": "nl", "fre": "fr", "geo": "ka", "ger": "de",
    "gre": "el", "ice": "is", "mac": "mk", "mao": "mi", "may": "ms", "per": "fa", "rum": "ro", "slo": "sk", "tib": "bo", "wel": "cy",
}

_P = np.uint64(0x9E3779B97F4A7C15)
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_COLUMNS = re.compile(r"\s{3,}")
_MARKS = re.compile(r"\s*[^\w\s][\W_]*")
_BROKEN = re.compile(r"[-=¬­‐‑~]\s*$")


_CODES: dict[str, str] = {}


def language_codes() -> dict[str, str]:
    """Two- and three-letter codes of the standard's languages, by the JVM's own table, to the two-letter code."""
    if not _CODES:
        locale = SparkSession.getActiveSession()._jvm.java.util.Locale
        two = {str(c) for c in locale.getISOLanguages()} - {"iw", "in", "ji"}
        three = {str(locale.forLanguageTag(c).getISO3Language()): c for c in two}
        _CODES.update({**LIBRARY_CODES, **three, **{c: c for c in two}})
    return _CODES


def named_language(label: Column) -> Column:
    """The two-letter code a label names, or null: region and letter case are ignored, three-letter codes translated."""
    base = F.lower(F.regexp_extract(F.trim(label), r"^([A-Za-z]{2,3})(?:[-_].*)?$", 1))
    return F.create_map(*[F.lit(x) for kv in sorted(language_codes().items()) for x in kv])[base]


def _windows(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All 5-character windows that end in a character of a word or in its end mark, and the word of each."""
    text = "".join("\x01" * (ORDER - 1) + w + "\x01" for w in words)
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
    which = np.repeat(np.arange(len(words)), sizes)
    begin = np.cumsum(np.r_[0, sizes[:-1] + ORDER - 1]) + ORDER - 1
    ends = np.arange(sizes.sum()) - np.repeat(np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.repeat(begin, sizes)
    return codes[ends[:, None] - np.arange(ORDER)[None, :]], which


def _hashes(w: np.ndarray) -> list[np.ndarray]:
    """Hashes of the last 1..5 characters of each window (column 0 is the last character)."""
    out, h = [], np.zeros(len(w), np.uint64)
    with np.errstate(over="ignore"):
        scale = np.uint64(1)
        for k in range(w.shape[1]):
            h = h + (w[:, k] + np.uint64(17)) * scale
            scale = scale * _P
            out.append(h)
    return out


def _find(keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Positions in a sorted hash array, -1 where absent."""
    if not len(keys):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[at] == h, at, -1)


@dataclass
class Models:
    """Sorted hash arrays per order: n-grams with log-probabilities, contexts with log back-off weights; one column a language."""

    languages: list[str]
    grams: list[np.ndarray]
    logp: list[np.ndarray]
    contexts: list[np.ndarray]
    back: list[np.ndarray]
    floor: float
    sharpness: float = 0.25
    reject: float = 99.0
    _cache: dict = field(default_factory=dict, repr=False)
    _rows: list = field(default_factory=list, repr=False)

    def score_words(self, words: list[str]) -> np.ndarray:
        """Sum of log-probabilities of each word's characters and end, one column a language."""
        w, which = _windows(words)
        grams = _hashes(w)
        contexts = _hashes(w[:, 1:])
        out = np.zeros((len(w), len(self.languages)), np.float32)
        todo = np.arange(len(w))
        for k in range(ORDER - 1, -1, -1):
            at = _find(self.grams[k], grams[k][todo])
            hit = at >= 0
            out[todo[hit]] += self.logp[k][at[hit]]
            todo = todo[~hit]
            if not len(todo):
                break
            if k:
                c = _find(self.contexts[k], contexts[k - 1][todo])
                out[todo[c >= 0]] += self.back[k][c[c >= 0]]
            else:
                out[todo] += self.floor
        sums = np.zeros((len(words), len(self.languages)))
        starts = np.flatnonzero(np.r_[True, which[1:] != which[:-1]]) if len(which) else np.empty(0, int)
        if len(starts):
            sums[:] = np.add.reduceat(out, starts, axis=0)
        return sums

    def lookup(self, words: list[str]) -> np.ndarray:
        """As :meth:`score_words`, each distinct word once a worker."""
        if len(self._cache) > CACHE_WORDS:
            self._cache.clear()
            self._rows.clear()
        cache = self._cache
        new = [w for w in dict.fromkeys(words) if w not in cache]
        if new:
            base = sum(map(len, self._rows))
            self._rows.append(self.score_words(new).astype(np.float32))
            cache.update(zip(new, range(base, base + len(new))))
            if len(self._rows) > 1:
                self._rows[:] = [np.concatenate(self._rows)]
        if not words:
            return np.zeros((0, len(self.languages)), np.float32)
        return self._rows[0][np.fromiter(map(cache.__getitem__, words), np.int64, len(words))]

    def __getstate__(self):
        return {**self.__dict__, "_cache": {}, "_rows": []}


def _kneser_ney(words: list[list[str]], weights: list[np.ndarray], languages: list[str]) -> Models:
    """Models of all languages over one shared set of n-grams; ``weights`` are word counts."""
    n = len(languages)
    windows, lang, count = [], [], []
    for i, (ws, c) in enumerate(zip(words, weights)):
        if ws:
            w, which = _windows(ws)
            windows.append(w), lang.append(np.full(len(w), i)), count.append(c[which])
    w, lang, count = np.concatenate(windows), np.concatenate(lang), np.concatenate(count).astype(np.float64)
    grams, contexts = _hashes(w), _hashes(w[:, 1:])
    alphabet = len(np.unique(w[:, 0]))
    keys_by, logp_by, ctx_by, back_by = [], [], [], []
    prob = None
    for k in range(ORDER):
        keys, first, inv = np.unique(grams[k], return_index=True, return_inverse=True)
        c = np.zeros((len(keys), n))
        if k == ORDER - 1:
            np.add.at(c, (inv, lang), count)
        else:  # in how many different characters' company an n-gram was seen
            longer = np.unique(np.stack([grams[k + 1], grams[k], lang.astype(np.uint64)]), axis=1)
            np.add.at(c, (np.searchsorted(keys, longer[1]), longer[2].astype(np.int64)), 1)
        ctx = contexts[k - 1][first] if k else np.zeros(len(keys), np.uint64)
        cu, cinv = np.unique(ctx, return_inverse=True)
        total, kinds = np.zeros((len(cu), n)), np.zeros((len(cu), n))
        np.add.at(total, cinv, c)
        np.add.at(kinds, cinv, c > 0)
        once, twice = (c == 1).sum(0), (c == 2).sum(0)
        d = np.where(once > 0, once / np.maximum(once + 2 * twice, 1), 0.5)
        d = np.clip(d, 0.1, 0.95)
        lam = np.where(total > 0, d * kinds / np.maximum(total, 1e-9), 1.0)
        lower = np.full((len(keys), n), 1.0 / (alphabet + 50)) if k == 0 else prob[_find(keys_by[-1], grams[k - 1][first])]
        prob = np.maximum(c - d, 0) / np.maximum(total[cinv], 1e-9) * (total[cinv] > 0) + lam[cinv] * lower
        keys_by.append(keys), logp_by.append(np.log(prob).astype(np.float32))
        ctx_by.append(cu), back_by.append(np.log(lam).astype(np.float32))
    return Models(languages, keys_by, logp_by, ctx_by, back_by, float(np.log(1.0 / (alphabet + 50))) - 2.0)


def page_lines(text: str) -> tuple[list[list[str]], list[bool], list[bool]]:
    """Words of each line piece (columns read across are pieces of their own), whether a word goes on in the next, and whether it has marks only."""
    words, broken, marks = [], [], []
    for line in text.splitlines():
        for piece in _COLUMNS.split(line):
            words.append(_WORD.findall(piece.lower()))
            broken.append(bool(_BROKEN.search(piece)))
            marks.append(not words[-1] and bool(_MARKS.fullmatch(piece)))
    return words, broken, marks


def _interruption(words: list[list[str]], marks: list[bool], own: list[int]) -> int:
    """How many of the pieces ``own`` have words and stand in no advert (what a pair of pieces of marks only encloses)."""
    n, opened = 0, None
    for k in own:
        if marks[k]:
            n, opened = (n, n) if opened is None else (opened, None)
        elif words[k]:
            n += 1
    return n


def _goes_on(words: list[list[str]], marks: list[bool], i: int, j: int, before: bool, after: bool) -> bool:
    """Whether pieces ``i`` and ``j`` of one language, only other languages between them, belong to one passage.

    Columns read in turn alternate: if the passage has every other piece before
    ``i`` or after ``j``, only every other piece between them is of its column.
    If the other column ended before the passage did, all pieces from there on are.
    """
    ways = [range(i + 1, j)]
    if (before or after) and (j - i) % 2 == 0:
        ways.append(range(i + 2, j, 2))
    if before:
        ways += [[*range(i + 2, end, 2), *range(end, j)] for end in range(i + 2, j)]
    return any(_interruption(words, marks, list(own)) <= PASSAGE_GAP for own in ways)


def _fitted(lines: list[tuple[int, list[str]]], languages: list[str]) -> Models:
    """Models fitted on (language number, words) lines, then refitted on the lines that their own language explains best."""
    models = None
    for _ in range(2):
        kept = lines
        if models is not None:
            best = _line_scores(models, [ws for _, ws in lines])[0].argmax(1)
            kept = [x for x, b in zip(lines, best) if x[0] == b]
        tallies: list[Counter] = [Counter() for _ in languages]
        for lang, ws in kept:
            tallies[lang].update(ws)
        models = _kneser_ney([list(t) for t in tallies], [np.fromiter(t.values(), np.float64, len(t)) for t in tallies], languages)
    models._cache.clear(), models._rows.clear()
    return models


def fit(pages: list[tuple[str, str]]) -> Models:
    """Models from (language, text) pages.

    Half of the pages is held out first: which labels are languages, how sharply
    lines tell them apart, and from which cross-entropy on text is rejected, is
    taken from models that did not see it. The models are then fitted on all
    pages. A language of one page is neither tested nor calibrated with.
    """
    seen: Counter = Counter()
    lines: list[tuple[str, int, list[str]]] = []
    for lang, text in pages:
        lines += [(lang, seen[lang] % 2, ws) for ws in page_lines(text)[0] if ws]
        seen[lang] += 1
    languages = sorted({lang for lang, _, _ in lines})
    if not languages:
        languages = sorted(seen)
    number = {lang: i for i, lang in enumerate(languages)}
    half = _fitted([(number[lang], ws) for lang, fold, ws in lines if fold == 0], languages) if lines else None
    held = [(number[lang], ws) for lang, fold, ws in lines if fold == 1]
    reject, sharpness, kept = Models.reject, Models.sharpness, languages
    if held and half is not None:
        truth = np.array([x[0] for x in held])
        scores, sizes = _line_scores(half, [ws for _, ws in held])
        tried = np.bincount(truth, minlength=len(languages))
        good = np.ones(len(languages), bool)
        while True:  # the label that explains least of its own goes first; the others are then judged without it
            best = np.where(good, scores, -np.inf).argmax(1)
            own = np.bincount(truth[best == truth], minlength=len(languages)) / np.maximum(tried, 1)
            weak = np.flatnonzero(good & (tried > 0) & (own < OWN_SHARE))  # a language without held-out lines stays
            if not len(weak) or good.sum() == 1:
                break
            good[min(weak, key=lambda i: (own[i], tried[i]))] = False
        kept = [lang for lang, ok in zip(languages, good) if ok]
        right = (best == truth) & good[truth] & (sizes >= REJECT_CHARS)
        if right.any():
            entropy = -scores[right, best[right]] / sizes[right]
            reject = float(np.quantile(entropy, 1 - REJECT_SHARE)) + 1.0
        # sharpness: the factor on log-probabilities under which the labels of the held-out lines are most likely
        usable = good[truth] & (sizes >= 10)
        if usable.any():
            s, t = scores[usable], truth[usable]
            grid = [0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.75, 1.0]
            loss = []
            for g in grid:
                z = g * (s - s.max(1, keepdims=True))
                p = np.exp(z[np.arange(len(t)), t]) / np.exp(z).sum(1)
                loss.append(-np.log(0.05 / len(languages) + 0.95 * p).mean())
            sharpness = max(0.2, grid[int(np.argmin(loss))])
    number = {lang: i for i, lang in enumerate(kept)}
    models = _fitted([(number[lang], ws) for lang, _, ws in lines if lang in number], kept)
    models.reject, models.sharpness = reject, sharpness
    return models


def _line_scores(models: Models, lines: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Log-probability of each line in each language, and the characters scored."""
    flat = [w for ws in lines for w in ws]
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    ends = np.r_[0, np.cumsum(sizes)]
    zero = np.zeros((1, len(models.languages)))
    total = np.r_[zero, np.cumsum(models.lookup(flat), axis=0, dtype=np.float64)]
    chars = np.r_[0, np.cumsum(np.fromiter((len(w) + 1 for w in flat), np.int64, len(flat)))]
    return total[ends[1:]] - total[ends[:-1]], chars[ends[1:]] - chars[ends[:-1]]


def _decide(models: Models, scores: np.ndarray, chars: np.ndarray, page: np.ndarray, pages: int) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each language for every line, under the mixture of languages of its page, and the mixtures."""
    n = len(models.languages)
    z = models.sharpness * scores
    like = np.exp(z - z.max(1, keepdims=True)) if len(z) else z
    mix = np.full((pages, n), 1.0 / n)
    weight = chars.astype(np.float64)
    post = like
    for _ in range(4):
        post = like * mix[page]
        post /= np.maximum(post.sum(1, keepdims=True), 1e-300)
        mass = np.stack([np.bincount(page, post[:, i] * weight, pages) for i in range(n)], axis=1)
        mix = (mass + 5.0) / (mass.sum(1, keepdims=True) + 5.0 * n)
    return post, mix


def detect_batch(models: Models, texts: list[str | None]) -> list[tuple[int, str, float, int, int, int, bool]]:
    """Passages of all pages: (page, language, confidence, words, first line, last line, is the page's main language)."""
    lines, page, number, glued = [], [], [], []
    pieces: dict[int, tuple[list[list[str]], list[bool]]] = {}
    for p, text in enumerate(texts):
        if text:
            ws, broken, marks = page_lines(text)
            pieces[p] = ws, marks
            for i, (w, b) in enumerate(zip(ws, broken)):
                if w:
                    lines.append(w), page.append(p), number.append(i), glued.append(b)
    out = []
    if not lines:
        return out
    page = np.array(page)
    scores, chars = _line_scores(models, lines)
    post, mix = _decide(models, scores, chars, page, len(texts))
    best = post.argmax(1)
    entropy = -scores[np.arange(len(lines)), best] / chars
    sure = post[np.arange(len(lines)), best]
    words = np.fromiter(map(len, lines), np.int64, len(lines)) - np.array(glued)
    best = np.where((entropy > models.reject) & (chars >= REJECT_CHARS), len(models.languages), best)
    codes = [*models.languages, UNKNOWN]
    starts = np.flatnonzero(np.r_[True, page[1:] != page[:-1]])
    for lo, hi in zip(starts, np.r_[starts[1:], len(page)]):
        p = int(page[lo])
        main = int(mix[p].argmax())
        read = lo + np.flatnonzero(best[lo:hi] < len(models.languages))
        if len(read) and (entropy[read] * chars[read]).sum() / chars[read].sum() > models.reject:
            best[read] = len(models.languages)  # short lines that only together can be rejected
            main = len(models.languages)
        elif not len(read):
            main = len(models.languages)
        for lang in np.unique(best[lo:hi]):
            mine = lo + np.flatnonzero(best[lo:hi] == lang)
            at = [number[k] for k in mine]
            far = np.flatnonzero(np.diff(mine) > PASSAGE_GAP + 1).tolist()
            ends = [k + 1 for k in far if not _goes_on(*pieces[p], at[k], at[k + 1], k > 0 and at[k] - at[k - 1] == 2, k + 2 < len(at) and at[k + 2] - at[k + 1] == 2)]
            for run in np.split(mine, ends):
                c = chars[run]
                certain = float((sure[run] * c).sum() / c.sum())
                out.append((p, codes[lang], certain if lang < len(models.languages) else 1 - certain, int(words[run].sum()), number[run[0]], number[run[-1]], bool(lang == main)))
    return out


def fit_on(docs: DataFrame, text: str = "text", label: str = "lang", id_col: str = "doc_id", pages: int = FIT_PAGES) -> Models | None:
    """Models fitted on at most ``pages`` labelled pages a language, chosen by a hash of their ids; None without any.

    Their count is bounded (16 salted parts of ``pages // 16`` each), their texts
    are whole. A language needs :data:`LEAST_PAGES` labelled pages of the whole corpus.
    """
    labelled = docs.select(F.col(id_col).alias("i"), named_language(F.col(label)).alias("l"), F.col(text).alias("t")).where(F.col("l").isNotNull() & (F.length("t") > 0))
    often = [r["l"] for r in labelled.groupBy("l").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_PAGES).select("l").collect()]  # codes of the standard
    labelled = labelled.where(F.col("l").isin(often))
    order = Window.partitionBy("l", "_s").orderBy("_h")
    # the choice is cut within 16 salted parts of each language first
    chosen = labelled.withColumn("_h", F.xxhash64("i")).withColumn("_s", F.pmod("_h", F.lit(16))).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= max(1, pages // 16))
    rows = [(r["l"], r["t"]) for r in chosen.select("l", "t", "_h").orderBy("_h").collect()]
    return fit(rows) if rows else None


def passages(docs: DataFrame, models: Models | None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_col, lang, confidence, words, first_line, last_line, is_main``: the passages of every page.

    Line numbers count line pieces from 0. Null, empty and blank texts and texts
    without letters have no passage; a page that no model explains has one
    passage with the language ``und``. A page whose text is repeated elsewhere
    gets the same passages. No shuffle; whole texts are read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shape = f"`{id_col}` {kind}, lang string, confidence double, words long, first_line long, last_line long, is_main boolean"
    rows = docs.select(id_col, text)
    if models is None:
        return rows.where(F.lit(False)).select(F.col(id_col), *[F.lit(None).cast(t).alias(n) for n, t in (("lang", "string"), ("confidence", "double"), ("words", "long"), ("first_line", "long"), ("last_line", "long"), ("is_main", "boolean"))])
    kept = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = kept.value
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                part = b.slice(lo, 2000)
                found = detect_batch(m, part.column(1).to_pylist())
                cols = list(zip(*found)) if found else [[]] * 7
                ids = part.column(0).take(pa.array(cols[0], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64()), *[pa.array(c, pa.int64()) for c in cols[3:6]], pa.array(cols[6], pa.bool_())],
                    names=[id_col, "lang", "confidence", "words", "first_line", "last_line", "is_main"],
                )

    return rows.mapInArrow(run, shape)


def unnamed(docs: DataFrame, found: DataFrame, words: int = PASSAGE_WORDS, id_col: str = "doc_id", label: str = "lang") -> DataFrame:
    """``id_col, lang``: languages with a passage of at least ``words`` words that the page's label does not name."""
    named = docs.select(id_col, named_language(F.col(label)).alias("_named"))
    long = found.where((F.col("words") >= words) & (F.col("lang") != UNKNOWN)).select(id_col, "lang").distinct()
    return long.join(named, id_col).where(~F.col("lang").eqNullSafe(F.col("_named"))).select(id_col, "lang")
