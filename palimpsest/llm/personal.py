"""Personal information in free text, found by how much its surroundings disclose.

Spans that could be personal are proposed by public notations: runs of digits,
house numbers with streets, addresses of mail boxes, words beside a title. Which
of them are, is estimated from the whole corpus: cue phrases anchor protected
entities; the co-occurrence of every feature of a proposal (the words before it,
its shape, its first signs) with anchored ones gives the bits by which the
feature discloses a kind; a proposal whose bits exceed the threshold is
protected. Words that occur mainly as parts of anchored names disclose a person
wherever they stand, with or without a cue. Protected spans are replaced by
typed placeholders, the rest of the text stays.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.payload import decoded_text
from palimpsest.session import BROADCAST_BYTES, cut, measured_bytes

#: Bits by which a name word must raise the probability of a person, and the share of its occurrences in anchored names that gives at least.
NAME_BITS, NAME_SHARE = 4.0, 0.3

# Words after which, or before which, an entity of a kind is named.
CUES = {
    "email": ["mail", "email", "address", "contact", "write to"],
    "phone": ["tel", "telephone", "phone", "mobile", "cell", "fax", "call", "sms to", "number is"],
    "idnum": ["id card no", "identity no", "id no", "passport", "passport no", "insurance number", "social security", "social security number", "ssn", "tax id", "national id", "personal number"],
    "address": ["moved to", "live at", "lives at", "address", "deliver to"],
}
TITLES = ["dr", "mr", "mrs", "ms", "miss", "prof", "sir", "herr", "frau"]
NAME_CUES = ["spoke with", "according to", "signed"]

# Words that name a kind of street.
STREETS_EN = "Street|Lane|Road|Avenue|Drive|Crescent|Close|Row|Quay|Bank|Square|Court|Place|Terrace|Hill|Way|Walk|Grove|Gardens|Mews|Park|Parade|Green"
STREETS_FR = "rue|avenue|place|quai|impasse|boulevard|chemin|allée|allee|cours|passage|ruelle|square|sentier"
STREETS_ES = "Calle|Plaza|Paseo|Avenida|Camino|Ronda|Travesía|Travesia|Carrera|Callejón|Callejon"
STREETS_DE = "straße|strasse|gasse|weg|platz|allee|ufer|ring|damm|markt|steig|graben|chaussee"
LEADS_DE = "Am|An der|An den|Im|In der|Auf der|Auf dem|Zum|Zur|Unter den|Obere|Oberer|Untere|Unterer|Alte|Alter|Neue|Neuer|Große|Kleine|Hintere|Vordere"

_MAIL = re.compile(r"(?<![\w.+\-])[\w.+\-]*\w[\w.+\-]*\s{0,2}(?:@|[(\[]\s?at\s?[)\]])\s{0,2}\w[\w\-]*(?:(?:\.|\s{0,2}[(\[]\s?dot\s?[)\]]\s{0,2})[^\W\d_][\w\-]*)+", re.I)
_NUMBER = re.compile(
    r"(?<![\w@.\-/:#+])(?:"
    r"[A-Za-z]{2}\d{2}-\d{4}/\d{2}"
    r"|[A-Za-z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Za-z](?!\w)"
    r"|[XYZxyz]\d{7}[A-Za-z]"
    r"|\d{8}-?[A-Za-z](?!\w)"
    r"|\d{3}\.\d{3}\.\d{3}-\d{2}"
    r"|\d{3}[- ]\d{2}[- ]\d{4}"
    r"|[+(]?\d(?:(?:[ .\-/]|\) ?| \()?\d){6,14}"
    r")(?!\w|[\-/]\d)"
)
_STREET = re.compile(
    r"(?<![\w.\-/])\d{1,4}(?:\s+bis|\s+ter|,)?\s+(?:" + STREETS_FR + r")\s+(?:de\s+la|de\s+l['’]|des|du|de)\s*[^\W\d_][\w'’\-]*(?:\s+[^\W\d_][\w'’\-]*)?"
    r"|(?:(?<!\w)(?:Flat|Apartment|Apt\.?|Unit|Floor)\s+\d+[a-z]?,?\s+)?(?<![\w.\-/])\d{1,4}[a-z]?\s+(?:[^\W\d_][\w'’\-]*\s+){1,3}(?:" + STREETS_EN + r")(?!\w)"
    r"|(?<!\w)(?:" + STREETS_ES + r")\s+(?:de\s+la|de\s+los|de\s+las|del|de)\s+(?:[^\W\d_][\w'’\-]*\s+){1,3}\d{1,4}(?:,\s*\d{1,3}\s?[ºª°]\s?[A-Za-z](?!\w))?"
    r"|(?<!\w)[^\W\d_][\w\-]*(?:" + STREETS_DE + r")\s+\d{1,4}[a-z]?(?!\w)"
    r"|(?<!\w)(?:" + LEADS_DE + r")\s+(?:[^\W\d_][\w\-]*\s+){1,2}\d{1,4}[a-z]?(?!\w)",
    re.I,
)
_SORT = re.compile(rf"(?<!\w)(?:{STREETS_FR}|{STREETS_EN}|{STREETS_ES})(?!\w)|(?:{STREETS_DE})(?!\w)|(?<!\w)(?:{LEADS_DE})(?!\w)", re.I)
# Words that go on after an address whose street has one word.
_AFTER = re.compile(r"\s+(?:last|before|please|and|or|is|was|has|by|for|in|at|on|to|with)$", re.I)
_WORD = re.compile(r"\b[^\W\d_]+\b")
_PLAIN = re.compile(r"\w+")

#: Share of entities among what stands after some words, and proposals seen there, from which the words are a cue.
CUE_SHARE, CUE_ROWS = 0.6, 10

SHAPE = "rec string, start int, span string, family string, features array<string>, anchor string"


def _cue_words(text: str, start: int) -> list[str]:
    """The three words before a place."""
    back = 40
    while True:
        lo = max(0, start - back)
        words = _PLAIN.findall(text[lo:start].lower())
        if len(words) > 3 or not lo:  # the first may be the rest of a longer one
            return words[-3:]
        back *= 4


def _anchored(words: list[str], kinds: tuple[str, ...]) -> str | None:
    joined = " " + " ".join(words)
    for kind in kinds:
        if any(joined.endswith(" " + c) for c in CUES[kind]):
            return kind
    return None


def proposals(text: str) -> list[tuple[int, str, str, list[str], str | None]]:
    """(start, span, family, features, anchored kind) of all spans in structured notations."""
    out = []
    taken: list[tuple[int, int]] = []
    if "@" in text or "at)" in text.lower() or "at]" in text.lower():
        for m in _MAIL.finditer(text):
            span, words = m.group(), _cue_words(text, m.start())
            # a plain sign is a mail box by its notation; spelled-out ones must disclose one by what they share with them
            name, _, host = re.sub(r"\s*[(\[]\s?at\s?[)\]]\s*", "@", re.sub(r"\s*[(\[]\s?dot\s?[)\]]\s*", ".", span.lower())).partition("@")
            shape = re.sub(r"\d+", "9", re.sub(r"[^\W\d_]+", "a", name))
            out.append((m.start(), span, "email", ["m1:" + " ".join(words[-1:]), "t:" + host.rpartition(".")[2].strip(), "l:" + shape], "email" if "@" in span or _anchored(words, ("email",)) else None))
            taken.append(m.span())
    for m in _STREET.finditer(text):
        span = m.group()
        if span[0].isdigit() and not re.search(rf"(?:{STREETS_EN})$", span, re.I):
            span = _AFTER.sub("", span)
            last = span.split()[-1]
            body = span.split()[-2]
            if last.islower() and not body.islower() and len(span.split()) > 4 - (", " in span):
                span = span[: span.rindex(last)].rstrip()
        words = _cue_words(text, m.start())
        kind = _anchored(words, ("address",))
        sort = _SORT.search(span)
        form = ["k:" + (sort.group().lower() if sort else ""), "s:" + re.sub(r"[^\W\d_]+", "a", re.sub(r"\d+", "9", span))]
        out.append((m.start(), span, "address", ["a1:" + " ".join(words[-1:]), "a2:" + " ".join(words[-2:]), *form], kind))
        if kind:
            taken.append((m.start(), m.start() + len(span)))
    for m in _NUMBER.finditer(text):
        if any(a <= m.start() < b for a, b in taken):
            continue
        span = m.group()
        words = _cue_words(text, m.start())
        shape = re.sub(r"[A-Za-z]", "A", re.sub(r"\d", "9", span))
        out.append((m.start(), span, "number", ["n1:" + " ".join(words[-1:]), "n2:" + " ".join(words[-2:]), "s:" + shape, "p:" + span[:3].upper()], _anchored(words, ("phone", "idnum"))))
    return out


def _proposed(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, cols = b.column(0).to_pylist(), [[], [], [], [], [], []]
            for i, t in zip(ids, b.column(1).to_pylist()):
                for start, span, family, features, anchor in proposals(t):
                    for c, v in zip(cols, (i, start, span, family, features, anchor)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.list_(pa.string())), pa.array(cols[5], pa.string())],
                names=["rec", "start", "span", "family", "features", "anchor"],
            )

    return rows.mapInArrow(run, SHAPE)


#: Features that tell how a proposal is written; the others tell what stands before it.
FORM = r"^[spltk]:"


def _bits(each: DataFrame, names: list[str]) -> DataFrame:
    """``feature, n, b_<kind>``: how much more often, as log2, a feature stands with entities of a kind (column ``anchor``) than with other proposals."""
    one = each.select("rec", "start", "anchor").distinct()
    total = one.agg(F.count(F.lit(1)).alias("every"), *[F.sum(F.col("anchor").eqNullSafe(k).cast("long")).alias(f"every_{k}") for k in names])
    counts = each.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("anchor").eqNullSafe(k).cast("long")).alias(f"n_{k}") for k in names])
    both = counts.join(F.broadcast(total))  # one row
    return both.select("feature", "n", *[
        F.log2(((F.col(f"n_{k}") + 0.5) / (F.col(f"every_{k}") + 1.0)) / ((F.col("n") - F.col(f"n_{k}") + 0.5) / (F.col("every") - F.col(f"every_{k}") + 1.0))).alias(f"b_{k}") for k in names
    ], *[F.log2((F.col(f"every_{k}") + 0.5) / (F.col("every") - F.col(f"every_{k}") + 0.5)).alias(f"prior_{k}") for k in names])


def _scored(each: DataFrame, bits: DataFrame, names: list[str]) -> DataFrame:
    """``rec, start, span, anchor`` with the bits of each kind, ``best`` of them, and its ``kind``."""
    sums = each.join(bits, "feature").groupBy("rec", "start", "span", "anchor").agg(*[(F.sum(f"b_{k}") + F.first(f"prior_{k}")).alias(k) for k in names])
    best = F.greatest(*[F.col(k) for k in names]) if len(names) > 1 else F.col(names[0])
    return sums.withColumn("best", best).withColumn("kind", F.coalesce(*[F.when(F.col(k) == F.col("best"), F.lit(k)) for k in names]))


def disclosed(found: DataFrame) -> DataFrame:
    """``rec, start, span, kind`` of the proposals whose features disclose a kind: the sum of their bits is positive.

    First the cue phrases anchor entities, and the bits of how they are written
    are counted over the whole corpus. What is written as entities are and
    stands where such mostly stand is then anchored too, so that words before an
    entity are learned; the bits are counted again with all features. The
    features are joined, not broadcast, so their number is free.
    """
    kinds = {"email": ["email"], "number": ["phone", "idnum"], "address": ["address"]}
    out = found.where("false").select("rec", "start", "span", F.lit("").alias("kind"))
    for family, names in kinds.items():
        mine = found.where(F.col("family") == family)
        each = mine.select("rec", "start", "span", "anchor", F.explode("features").alias("feature"))
        form, place = each.where(F.col("feature").rlike(FORM)), each.where(~F.col("feature").rlike(FORM))
        written = _scored(form, _bits(form, names), names).select("rec", "start", F.when(F.col("best") > 0, F.col("kind")).alias("as"))
        seen = place.join(written, ["rec", "start"])
        said = [F.avg((F.col("as").eqNullSafe(k) | F.col("anchor").eqNullSafe(k)).cast("double")).alias(f"m_{k}") for k in names]
        cues = seen.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), *said)
        cue = F.coalesce(*[F.when(F.col(f"m_{k}") >= CUE_SHARE, F.lit(k)) for k in names])
        learned = place.join(cues.where(F.col("n") >= CUE_ROWS).select("feature", cue.alias("cue")).where("cue is not null"), "feature")
        learned = learned.groupBy("rec", "start").agg(F.min("cue").alias("cue")).join(written, ["rec", "start"]).where("cue = as")
        again = cut(each.join(learned.select("rec", "start", "cue"), ["rec", "start"], "left").withColumn("anchor", F.coalesce("anchor", "cue")).drop("cue"))
        out = out.unionByName(_scored(again, _bits(again, names), names).where("best > 0").select("rec", "start", "span", "kind"))
    return out


def _name_anchors(text: str) -> list[str]:
    """Words in the places of a name beside a title or another cue."""
    out: list[str] = []
    for m in _ANCHOR.finditer(text):
        at = m.end()
        for _ in range(2):
            word = _LONG_WORD.search(text, at)
            if word is None:
                break
            out.append(word.group().lower())
            at = word.end()
    return out


_LONG_WORD = re.compile(r"[^\W\d_]{2,}")
_ANCHOR = re.compile(r"(?<!\w)(?:(?:" + "|".join(TITLES) + r")\.\s+|(?:" + "|".join(c.replace(" ", r"\s+") for c in NAME_CUES) + r"),?\s+)(?!the\b)", re.I)
#: Different words a task counts before it passes the counts on.
COUNTED = 400_000


def name_words(rows: DataFrame) -> DataFrame:
    """``word, bits, share``: words that disclose a person, from their co-occurrence with name anchors over the whole corpus.

    Anchored occurrences and all occurrences are counted in one pass.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        anchored: Counter = Counter()

        def given() -> pa.RecordBatch:
            words = list(total)
            out = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(total.values()), pa.int64()), pa.array([anchored[w] for w in words], pa.int64())], names=["word", "n", "anchored"])
            total.clear(), anchored.clear()
            return out

        for b in batches:
            for t in b.column(1).to_pylist():
                total.update(_WORD.findall(t.lower()))
                anchored.update(_name_anchors(t))
                if len(total) > COUNTED:
                    total.update(dict.fromkeys(anchored, 0))
                    yield given()
        total.update(dict.fromkeys(anchored, 0))
        yield given()

    counts = cut(rows.mapInArrow(count, "word string, n long, anchored long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("anchored").alias("anchored")))
    sums = counts.agg(F.sum("anchored").alias("a"), F.sum("n").alias("n")).first()
    person = max(sums["a"] or 0, 1) / max(sums["n"] or 0, 1)
    share = F.col("anchored") / (F.col("n") + F.lit(1.0))
    return counts.where("anchored > 0").select("word", F.log2(share / F.lit(float(person))).alias("bits"), share.alias("share")).where((F.col("bits") >= NAME_BITS) & (F.col("share") >= NAME_SHARE))


_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")


def name_spans(text: str, known: frozenset) -> list[tuple[int, str]]:
    """Runs of name words, with initials, hyphens or one inverted comma between; at least two words, or a word and an initial."""
    toks = [(m.start(), m.end(), m.group().lower()) for m in _TOKEN.finditer(text)]
    hits = [i for i, t in enumerate(toks) if t[2] in known]
    out, done = [], -1
    for i in hits:
        if i <= done:
            continue
        lo = hi = i
        names, initials, commas = 1, 0, 0
        if i and len(toks[i - 1][2]) == 1 and re.fullmatch(r"\.\s*", text[toks[i - 1][1] : toks[i][0]]) and i - 1 > done:
            lo, initials = i - 1, 1
        while hi + 1 < len(toks):
            gap = text[toks[hi][1] : toks[hi + 1][0]]
            nxt = toks[hi + 1][2]
            if nxt in known and (re.fullmatch(r"\s+|-", gap) or (gap.startswith(".") and len(toks[hi][2]) == 1 and re.fullmatch(r"\.\s*", gap)) or (names == 1 and not initials and not commas and re.fullmatch(r",\s+", gap))):
                commas += "," in gap
                names += 1
                hi += 1
            elif len(nxt) == 1 and re.fullmatch(r"\s+", gap) and hi + 2 < len(toks) and toks[hi + 2][2] in known and re.fullmatch(r"\.\s*", text[toks[hi + 1][1] : toks[hi + 2][0]]):
                initials += 1
                names += 1
                hi += 2
            else:
                break
        done = hi
        if names + initials >= 2:
            out.append((toks[lo][0], text[toks[lo][0] : toks[hi][1]]))
    return out


def _names(rows: DataFrame, words: DataFrame) -> DataFrame:
    """``rec, start, span, kind``: persons, by the learned name words."""
    words = cut(words.select("word"))
    shape = "rec string, start int, span string, kind string"

    def spans(ids: list, texts: list[str], known) -> pa.RecordBatch:
        cols: list[list] = [[], [], []]
        for i, t, k in zip(ids, texts, known):
            for start, span in name_spans(t, k):
                cols[0].append(i), cols[1].append(start), cols[2].append(span)
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(["person"] * len(cols[0]), pa.string())], names=["rec", "start", "span", "kind"])

    if measured_bytes(words) <= BROADCAST_BYTES:
        kept = rows.sparkSession.sparkContext.broadcast(frozenset(words.toArrow().column(0).to_pylist()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids = b.column(0).to_pylist()
                yield spans(ids, b.column(1).to_pylist(), [kept.value] * len(ids))

        return rows.mapInArrow(run, shape)
    # too many words to broadcast: each text gets the name words it holds by a join
    mine = rows.select("rec", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))).alias("word")).join(words, "word").groupBy("rec").agg(F.collect_list("word").alias("known"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield spans(b.column(0).to_pylist(), b.column(1).to_pylist(), [frozenset(k) for k in b.column(2).to_pylist()])

    return rows.join(mine, "rec").select("rec", "text", "known").mapInArrow(joined, shape)


def disjoint(spans: list[tuple[int, str, str]]) -> list[tuple[int, str, str]]:
    """Of overlapping (start, span, kind) the longest, at one length the first; then all that overlap none of those that stand."""
    starts: list[int] = []
    kept: list[tuple[int, str, str]] = []
    for s in sorted(set(spans), key=lambda s: (-len(s[1]), s[0], s[2])):
        at = bisect_left(starts, s[0])
        before = at and kept[at - 1][0] + len(kept[at - 1][1]) > s[0]
        after = at < len(kept) and kept[at][0] < s[0] + len(s[1])
        if not before and not after:
            starts.insert(at, s[0])
            kept.insert(at, s)
    return kept


def _texts(atoms: DataFrame, id_col: str, payload: str) -> DataFrame:
    return atoms.select(F.col(id_col).cast("string").alias("rec"), decoded_text(F.col(payload)).alias("text")).where(F.length("text") > 0).withColumn("digest", F.md5("text"))


def text_spans(atoms: DataFrame, id_col: str = "id", payload: str = "payload") -> DataFrame:
    """``digest, start, span, kind``: the protected spans of every distinct decoded text, ``digest`` its MD5.

    Where spans overlap the longest stands, of equally long ones the first, and
    everything that overlaps none of those. All co-occurrences are counted over
    distinct texts, so that copies of one text, however many, teach nothing.
    """
    rows = cut(_texts(atoms, id_col, payload).groupBy("digest").agg(F.first("text").alias("text"))).select(F.col("digest").alias("rec"), "text")
    noted = rows.where(F.col("text").rlike(r"[0-9@]|(?i)at ?[)\]]"))  # every notation has one of these
    found = cut(disclosed(cut(_proposed(noted))).unionByName(_names(rows, name_words(rows))))
    lists = found.groupBy("rec").agg(F.collect_list(F.struct("start", "span", "kind")).alias("s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, stay = b.column(0).to_pylist(), [disjoint([(s["start"], s["span"], s["kind"]) for s in one]) for one in b.column(1).to_pylist()]
            flat = [(i, *s) for i, one in zip(ids, stay) for s in one]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in flat], t) for k, t in enumerate((pa.string(), pa.int32(), pa.string(), pa.string()))], names=["digest", "start", "span", "kind"])

    return lists.mapInArrow(run, "digest string, start int, span string, kind string")


def personal_spans(atoms: DataFrame, id_col: str = "id", payload: str = "payload") -> DataFrame:
    """``rec, start, span, kind``: every protected span in the decoded texts (see :func:`text_spans`).

    Null and empty payloads have none; repeated texts are reported each. Whole
    texts are read. An empty table gives no rows.
    """
    return _texts(atoms, id_col, payload).select("rec", "digest").join(text_spans(atoms, id_col, payload), "digest").select("rec", "start", "span", "kind")


def _raw_offsets(raw: str, at: int) -> tuple[str, list[int]]:
    """The string that the JSON literal at ``at`` (its opening quote) stands for, and where each of its characters is written."""
    text, end = json.decoder.scanstring(raw, at + 1)
    where, i = [], at + 1
    while i < end - 1:
        where.append(i)
        if raw[i] != "\\":
            i += 1
        elif raw[i + 1] != "u":
            i += 2
        else:
            high = 0xD800 <= int(raw[i + 2 : i + 6], 16) < 0xDC00 and raw[i + 6 : i + 8] == "\\u" and 0xDC00 <= int(raw[i + 8 : i + 12], 16) < 0xE000
            i += 12 if high else 6
    where.append(end - 1)
    return text, where


_GAP = re.compile(r"\s*")


def _content_at(raw: str) -> int | None:
    """Where the value of the field ``content`` of a JSON object begins, if it is a string."""
    decoder, found = json.JSONDecoder(), None
    i = _GAP.match(raw).end() + 1
    while True:
        i = _GAP.match(raw, i).end()
        if raw[i] != '"':
            return found
        key, i = json.decoder.scanstring(raw, i + 1)
        i = _GAP.match(raw, _GAP.match(raw, i).end() + 1).end()  # past the colon
        if key == "content":
            found = i if raw[i] == '"' else None
        _, i = decoder.raw_decode(raw, i)
        i = _GAP.match(raw, i).end()
        if raw[i] != ",":
            return found
        i += 1


def spliced(payload: str, text: str, spans: list[tuple[int, str, str]]) -> str:
    """The payload with a placeholder in the place of each span of its decoded text; all else as it was written."""
    where: list[int] | range = range(len(payload) + 1)
    if payload != text:
        try:
            begin = _GAP.match(payload).end()
            at = begin if payload[begin] == '"' else _content_at(payload)
            said, where = _raw_offsets(payload, at) if at is not None else (None, where)
        except (ValueError, IndexError):
            said = None
        if said != text:  # a value that is written as JSON, not as a string: its characters are looked for
            at = payload.find(text)
            if at < 0:
                return payload
            where = range(at, at + len(text) + 1)
    out, last = [], 0
    for start, span, kind in sorted(spans):
        out += [payload[last : where[start]], f"<{kind.upper()}>"]
        last = where[start + len(span)]
    return "".join([*out, payload[last:]])


def redacted(atoms: DataFrame, spans: DataFrame, id_col: str = "id", payload: str = "payload") -> DataFrame:
    """``id_col, payload, redacted``: payloads with a placeholder such as ``<EMAIL>`` for every span, all else unchanged.

    ``spans`` are those of :func:`text_spans`, or of :func:`personal_spans`. They
    are replaced where they stand, JSON escapes included; the same signs
    elsewhere in a text stay. Rows without spans keep their payload; null stays null.
    """
    key = "digest" if "digest" in spans.columns else "rec"
    lists = spans.groupBy(F.col(key).alias("_key")).agg(F.collect_set(F.struct("start", "span", "kind")).alias("_spans"))
    kind = atoms.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in (1, 2, 3)))
            out = [spliced(p, t, [(s["start"], s["span"], s["kind"]) for s in found]) if found else p for p, t, found in rows]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], names=[id_col, payload, "redacted"])

    text = decoded_text(F.col(payload))
    own = F.md5(text) if key == "digest" else F.col(id_col).cast("string")
    joined = atoms.select(id_col, payload, text.alias("_text"), own.alias("_key")).join(lists, "_key", "left")
    return joined.select(id_col, payload, "_text", "_spans").mapInArrow(run, f"`{id_col}` {kind}, `{payload}` string, redacted string")
