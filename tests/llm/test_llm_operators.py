import json
import os
import random
import sys
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.functions.payload import decoded_text
from palimpsest.llm import identical, language, leakage, neighbours, personal, ranking, similar, tokens

ATOM = "id string, payload string"


def pair_set(df):
    return {(r["id_a"], r["id_b"]) for r in df.collect()}


# ---- formatting copies


def test_formatting_classes(spark):
    rows = [
        ("a", json.dumps({"role": "user", "content": "Café, au lait!"})),
        ("b", '{ "content":"CAFÉ au\\u00a0LAIT" , "Role":"USER"}'),
        ("c", json.dumps("café au lait")),
        ("d", "Café au; lait"),
        ("e", json.dumps({"role": "user", "content": "Café, au lait!", "turn": 1})),
        ("f", None),
        ("g", " .. "),
        ("h", ""),
        ("i", '{"x": ""}'),
    ]
    df = spark.createDataFrame(rows, ATOM).withColumn("tuple", F.lit(1)).withColumn("raw", F.lit("x"))
    classes = identical.formatting_classes(df)
    assert pair_set(identical.pairs_within(classes)) == {("a", "b"), ("c", "d")}
    assert {r["class_id"]: r["copies"] for r in identical.collapsed(classes).collect()} == {"a": 2, "c": 2, "e": 1}
    assert identical.formatting_classes(df.limit(0)).count() == 0
    keys = {r["id"]: bytes(r["k"]) for r in df.where("payload is not null").select("id", identical.formatting_key(F.col("payload")).alias("k")).collect()}
    assert keys["a"] == keys["b"] != keys["e"] and keys["c"] == keys["d"] != keys["a"]


# ---- nearest neighbours


def brute_neighbours(ids, x, k, least=None):
    s = x @ x.T
    out = {}
    for i, a in enumerate(ids):
        order = sorted((j for j in range(len(ids)) if j != i and (least is None or s[i, j] >= least)), key=lambda j: (-round(float(s[i, j]), 6), ids[j]))
        out[a] = [ids[j] for j in order[:k]]
    return out


@pytest.mark.parametrize("least,recall", [(None, 0.97), (0.9, 0.98)])
def test_neighbours_recall(spark, least, recall):
    rng = np.random.default_rng(0)
    centre = rng.normal(size=(30, 16))
    x = centre[rng.integers(0, 30, 1500)] + rng.normal(size=(1500, 16)) * 0.35
    x = np.concatenate([x, x[:300] + rng.normal(size=(300, 16)) * 0.05]).astype(np.float32)
    ids = [f"v{i:05d}" for i in range(len(x))]
    df = spark.createDataFrame(list(zip(ids, x.tolist())), "id string, embedding array<float>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(a, b) for a, bs in brute_neighbours(ids, unit, 5, least).items() for b in bs}
    got = {(r["rec"], r["neighbour"]) for r in neighbours.neighbours(df, 16, 5, least=least, recall=recall).collect()}
    assert len(got & want) >= 0.9 * len(want) and len(got) <= len(want) + 5


def test_neighbours_edge_cases(spark):
    rows = [(f"c{i:02d}", [1.0, 0.0]) for i in range(20)] + [("long", [5.0, 0.0]), ("far", [0.0, 1.0]), ("zero", [0.0, 0.0]), ("nan", [float("nan"), 1.0]), ("short", [1.0]), ("empty", []), ("null", None)]
    df = spark.createDataFrame(rows, "id string, embedding array<float>").withColumn("vec", F.lit(1)).withColumn("cell", F.lit(2))
    got = {}
    for r in neighbours.neighbours(df, 2, 3, least=0.9).collect():
        got.setdefault(r["rec"], []).append(r["neighbour"])
    assert sorted(got) == sorted(f"c{i:02d}" for i in range(20)) + ["long"]
    assert sorted(got["long"]) == ["c00", "c01", "c02"] and sorted(got["c00"]) == ["c01", "c02", "c03"]
    assert neighbours.neighbours(df.limit(0), 2, 3).count() == 0
    asked = spark.createDataFrame([("far",)], "rec string")
    some = neighbours.neighbours(df, 2, 3, queries=asked).collect()
    assert {r["rec"] for r in some} == {"far"} and len(some) == 3


# ---- personal information


def test_name_runs():
    known = frozenset(["zofia", "velder", "umbach", "anneke", "noémie"])
    found = lambda t: [s for _, s in personal.name_spans(t, known)]
    assert found("Dr. Zofia E. Velder-Umbach left. Anneke Velder stayed") == ["Zofia E. Velder-Umbach", "Anneke Velder"]
    assert found("to Velder, Zofia and Z. Umbach; NOÉMIE VELDER") == ["Velder, Zofia", "Z. Umbach", "NOÉMIE VELDER"]
    assert found("Zofia alone. Umbach") == [] and found("") == []


def test_personal_spans(spark):
    people = ["Ilka Brandt", "Tomas Rehn", "Brandt, Tomas", "Ilka Rehn"]
    streets = ["12b Mill Lane", "4 bis rue du Vieux Port", "Seilergasse 9", "Calle de los Olmos 3, 2º B"]
    rows = []
    for i in range(40):
        rows += [
            (f"p{i}", json.dumps(f"Dr. {people[i % 4]} signed the form. Tel +44 7700 900{i:03d}.")),
            (f"q{i}", json.dumps({"role": "user", "content": f"{people[(i + 1) % 4]} will bring it. Passport ZZ{i:02d}-1234/56 expires soon, moved to {streets[i % 4]} last spring."})),
            (f"r{i}", f"Part number PX 48 74 48 C of invoice 2024-21-58{i:02d} is for ilka{i}@example.org (not retries@{i} and the form)."),
        ]
    rows += [("n", None), ("e", ""), ("long", json.dumps("word " * 30000 + "Tel +44 7700 900999."))]
    df = spark.createDataFrame(rows, ATOM).withColumn("start", F.lit(1)).withColumn("rec", F.lit("x"))
    spans = personal.personal_spans(df)
    got = {(r["rec"], r["kind"], r["span"]) for r in spans.collect()}
    want = set()
    for i in range(40):
        want |= {(f"p{i}", "person", people[i % 4]), (f"p{i}", "phone", f"+44 7700 900{i:03d}"), (f"q{i}", "person", people[(i + 1) % 4]), (f"q{i}", "idnum", f"ZZ{i:02d}-1234/56"), (f"q{i}", "address", streets[i % 4]), (f"r{i}", "email", f"ilka{i}@example.org")}
    want.add(("long", "phone", "+44 7700 900999"))
    assert got == want
    red = {r["id"]: r["redacted"] for r in personal.redacted(df, spans).collect()}
    assert red["p0"] == json.dumps("Dr. <PERSON> signed the form. Tel <PHONE>.") and red["n"] is None and red["e"] == ""
    assert json.loads(red["q3"])["content"].endswith("moved to <ADDRESS> last spring.")
    assert personal.personal_spans(df.limit(0)).count() == 0


def test_copies_of_one_payload_do_not_unlearn_its_name(spark):
    rows = [(f"p{i}", f"Dr. {['Anna Velder', 'Ilka Berg', 'Anna Berg'][i % 3]} signed form {i} of the day.") for i in range(30)]
    rows += [(f"h{i}", "Anna Berg called about the mill") for i in range(300)]
    rows += [(f"x{i}", f"The mill wheel turned {i} times while rain fell on the roof of the house") for i in range(300)]
    got = {(r["rec"], r["kind"], r["span"]) for r in personal.personal_spans(spark.createDataFrame(rows, ATOM)).collect()}
    want = {(f"p{i}", "person", ["Anna Velder", "Ilka Berg", "Anna Berg"][i % 3]) for i in range(30)}
    assert got == want | {(f"h{i}", "person", "Anna Berg") for i in range(300)}


# ---- fused ranking


def test_fused_ranking(spark):
    rng = random.Random(3)
    rows = []
    for q in ["hot"] * 120 + ["b"] * 20 + ["c"]:
        base = rng.random()
        rows.append((q, f"i{len(rows):03d}", int(base * 1e6), rng.choice([base, base, None]), base + rng.random() * 0.2))
    rows.append(rows[0])
    df = spark.createDataFrame(rows, "q string, i string, x long, y double, z double").withColumn("position", F.lit(0)).withColumn("_size", F.lit(0))
    got = ranking.fused_ranking(df, "q", "i", ["x", "y", "z"]).collect()
    assert len(got) == len(rows) - 1
    for q in ("hot", "b", "c"):
        mine = [r for r in got if r["q"] == q]
        order = sorted(mine, key=lambda r: (-r["projection"], r["i"]))
        assert [r["position"] for r in order] == list(range(1, len(mine) + 1))
        for r in mine:
            assert r["x_rank"] == 1 + sum(o["x"] > r["x"] for o in mine)
            assert r["y_rank"] == 1 + sum(o["y"] is not None and (r["y"] is None or o["y"] > r["y"]) for o in mine)
    assert ranking.fused_ranking(df.limit(0), "q", "i", ["x", "y", "z"]).count() == 0


def test_first_component_is_not_dominated_by_range(spark):
    rows = [(i / 50, (50 - i) / 50 if i % 7 else i / 50, i / 50) for i in range(50)]
    w = ranking.first_component(spark.createDataFrame(rows, "a double, b double, c double"), ["a", "b", "c"])
    assert w[0] == pytest.approx(w[2]) and w[0] > 0 and w[1] < 0 and sum(w) > 0  # b opposes the others
    assert ranking.first_component(spark.createDataFrame([(1.0, 1.0)], "a double, b double"), ["a", "b"]) == pytest.approx([0.7071, 0.7071], abs=1e-3)


# ---- near duplicates


def test_sketches_agree_as_sets_do():
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(4000)]
    for share in (0.5, 0.75, 0.9):
        texts = []
        for _ in range(60):
            n = 80
            both = list(rng.choice(words, int(n * share), replace=False))
            rest = list(rng.choice(words, 2 * (n - len(both)), replace=False))
            texts += [" ".join(both + rest[: n - len(both)]), " ".join(both + rest[n - len(both) :])]
        h, s = similar.word_sets(texts)
        sk = similar.sketches(h, s, 160)
        true = [similar._jaccard(h[s[i] : s[i + 1]], h[s[i + 1] : s[i + 2]]) for i in range(0, len(texts), 2)]
        got = [(sk[i] == sk[i + 1]).mean() for i in range(0, len(texts), 2)]
        assert abs(np.mean(got) - np.mean(true)) < 0.03
    h, s = similar.word_sets(["a", "", None, "b a B A"])
    assert list(np.diff(s)) == [1, 0, 0, 2]
    assert (similar.sketches(h, s, 64)[0] != np.iinfo(np.uint64).max).all()


def test_near_pairs_match_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for i in range(120):
        base = rng.sample(words, 50)
        rows.append((f"a{i}", " ".join(base)))
        for j in range(rng.choice([0, 1, 1, 4])):
            copy = list(base)
            for _ in range(rng.choice([0, 2, 4, 12])):
                copy[rng.randrange(50)] = rng.choice(words)
            rng.shuffle(copy)
            rows.append((f"a{i}_{j}", json.dumps(" ".join(copy))))
    rows += [("n", None), ("e", ""), ("s", ".,"), ("x", rows[0][1].upper())]
    df = spark.createDataFrame(rows, ATOM)
    p = F.col("payload")
    members, links = similar.similar_sets(df.where(p.isNotNull()).select(F.col("id").alias("rec"), identical.formatting_key(p).alias("grp"), decoded_text(p).alias("text")), 0.7)
    sets = {i: (t and set(similar.WORD.findall(json.loads(t).lower() if t[:1] == '"' else t.lower()))) for i, t in rows}
    flat = lambda t: "".join(c for c in (json.loads(t) if t[:1] == '"' else t).lower() if c.isalnum())
    text = dict(rows)
    want = set()
    ids = sorted(i for i in sets if sets[i])
    for a in range(len(ids)):
        for b in range(a + 1, len(ids)):
            x, y = sets[ids[a]], sets[ids[b]]
            if len(x & y) / len(x | y) >= 0.7 and flat(text[ids[a]]) != flat(text[ids[b]]):
                want.add((ids[a], ids[b]))
    got = pair_set(similar.near_pairs(members, links))
    assert got <= want and len(got) >= 0.98 * len(want)
    classes = {r["rec"]: r["class_id"] for r in similar.classes(members, links).collect()}
    assert all(classes[a] == classes[b] for a, b in got) and classes["x"] == classes["a0"] and set(classes) == set(ids)
    empty = df.limit(0).select(F.col("id").alias("rec"), identical.formatting_key(p).alias("grp"), p.alias("text"))
    assert similar.near_pairs(*similar.similar_sets(empty, 0.7)).count() == 0


def test_near_pairs_in_a_family_of_a_third_of_all_rows(spark):
    rng = random.Random(8)
    base = [f"c{i}" for i in range(72)]
    own = lambda i, k: [f"r{i}x{j}" for j in range(k)]
    rows = []
    for i in range(60):
        # plain similarities of 0.90 and less with the bare text, whose words are all frequent
        rows.append((f"f{i}", " ".join(rng.sample(base, 72) + own(i, rng.choice([4, 8, 18, 24])))))
        rows.append((f"t{i}", " ".join([f"n{j}" for j in range(8)] + own(f"t{i % 40}", 3 if i % 2 else 2))))
    rows += [(f"o{i}", " ".join(own(f"o{i}", 40))) for i in range(60)] + [("bare", " ".join(base)), ("note", " ".join(f"n{j}" for j in range(8)))]
    df = spark.createDataFrame(rows, "rec string, text string").withColumn("grp", F.col("rec").cast("binary"))
    got = pair_set(similar.near_pairs(*similar.similar_sets(df.select("rec", "grp", "text"), 0.7)))
    sets = {i: set(t.split()) for i, t in rows}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b])}
    assert len(want) > 500 and got == want


# ---- tokens


@pytest.mark.skipif(not os.path.isdir(tokens.TOKENIZERS), reason="vocabularies are not here")
def test_token_ids_equal_the_public_encoder(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    rng = random.Random(2)
    texts = ["", None, " ", "a  b\n\n c", "It's<|endoftext|>ok", "ſchön 📰 ­ x", "x" * 300, "".join(rng.choice("ab  \n'sé9.") for _ in range(5000)), ("word's  12 " * 40000)[:250_001]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit(1))
    got = {r["doc_id"]: r["ids"] for r in tokens.encoded(df).collect()}
    enc = tokens.encoder(f"{tokens.TOKENIZERS}/byte_bpe_50k.tiktoken")
    for i, text in enumerate(texts):
        assert got[i] == (t.encode(text, add_special_tokens=False).ids if text else [])
        assert tokens.decode_ids(enc, got[i]) == (text or "").encode()
    assert tokens.encoded(df.limit(0)).count() == 0


def test_pieces_only_cut_where_the_pattern_does():
    text = "ab  c d 'e fé\n g " * 50
    assert "".join(tokens.pieces(text, 40)) == text and len(list(tokens.pieces(text, 40))) > 5
    assert list(tokens.pieces("x" * 500, 100)) == ["x" * 500]


# ---- leaked evaluation texts

ITEMS = [
    (1, "A swinging pendulum near the copper jar repeats 458 slow steps before the final needle stops and the glass lid stays closed for good"),
    (2, "The salt solution beside the window gains exactly seventy degrees when nobody touches the wooden table in the long winter evening"),
]


def broken(text, width, rng, noise):
    out, line = [], ""
    for w in text.split():
        w = "".join(rng.choice("aeiou") if c.isalpha() and rng.random() < noise else c for c in w)
        if len(line) + len(w) > width:
            out.append(line)
            line = ""
        line += w + " "
    return [*out, line]


def test_leaks(spark):
    rng = random.Random(4)
    filler = "The town council discussed the roof of the corn exchange while the rain continued to fall on the quay this morning and no one was hurt at all"
    words = ITEMS[0][1].split()
    other = broken(filler, 32, rng, 0)
    mine = broken(" ".join(words[2:20]), 32, rng, 0.05)
    turns = [x for p in zip(mine, other) for x in p]
    pages = {
        1: filler,
        2: filler + "\n" + "\n".join(broken(ITEMS[0][1].upper(), 34, rng, 0.06)) + "\n" + filler,
        3: "\n".join(turns),
        4: filler + " " + " ".join(words[:9]) + " " + filler,
        5: filler + " " + " ".join(words).replace("458", "459") + " " + filler,
        6: "\n".join(broken(ITEMS[1][1], 30, rng, 0)).replace("exactly", "exac-\ntly"),
        7: None,
        8: "",
        9: "\n".join(f"{a:<45}{b}" for a, b in zip(broken(filler, 36, rng, 0), broken(ITEMS[1][1], 36, rng, 0.03))),
        10: (filler + "\n") * 400 + "\n".join(broken(ITEMS[1][1], 40, rng, 0)),
    }
    docs = spark.createDataFrame(list(pages.items()), "doc_id long, text string").withColumn("item_id", F.lit(0)).withColumn("n", F.lit(0))
    items = spark.createDataFrame([*ITEMS, (3, None), (4, ""), (5, "too short")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leakage.leaks(docs, items).collect()}
    # of page 5 the part after the changed number is still long enough
    assert got == {(2, 1), (3, 1), (5, 1), (6, 2), (9, 2), (10, 2)}
    assert leakage.leaks(docs.limit(0), items).count() == 0 and leakage.leaks(docs, items.limit(0)).count() == 0


def test_an_item_is_tried_whatever_another_item_has_on_the_page():
    words = "vault coral fibre grape haste ivory joker knife lemon mango noble olive piano quilt raven sugar tulip umber wheat yacht zebra acorn birch cedar".split()
    texts = [" ".join(words), " ".join([*words[6:18], "nothing", "else", "of", "this", "stands", "there"])]
    it = leakage.Items([1, 2], texts)
    it.choose(np.ones(len(it.keys), np.int64))
    # either line carries twice as much of the first item as of the second
    got = leakage.leaks_in(it, [" ".join(words[:12]) + "\n" + " ".join(words[12:]), " ".join(words[:6])])
    assert {(p, i) for p, i, _ in got} == {(0, 0), (0, 1)}


def test_a_passage_that_many_items_share_leaks_for_all(spark, monkeypatch):
    rng = random.Random(12)
    shared = "the jury of the fair gave its prize to the keeper of the old toll bridge".split()
    own = lambda: ["".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(6)) for _ in range(14)]
    items = [(i, " ".join(own() + shared + own())) for i in range(20)]
    docs = spark.createDataFrame([(1, "\n".join(broken(" ".join(shared), 40, rng, 0))), (2, " ".join(own()))], "doc_id long, text string")
    want = {(1, i) for i in range(20)}
    for block in (2_000, 5):
        monkeypatch.setattr(leakage, "ITEM_BLOCK", block)
        rows = leakage.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
        assert {(r["doc_id"], r["item_id"]) for r in rows} == want


def test_every_run_of_item_words_has_seeds():
    text = "so we go on as he is in it or up to an ox by my sea at no end of day if I am"
    it = leakage.Items([i for i in range(20)], [text] * 20)
    it.choose(np.ones(len(it.keys), np.int64))
    for i in range(len(text.split()) - leakage.RUN_WORDS + 1):
        at = np.flatnonzero((it.word >= i) & (it.word < i + leakage.RUN_WORDS))
        inside = (it.pos >= at[0]) & (it.pos <= at[-1] + 1 - leakage.GRAM)
        assert it.kept[inside].sum() == min(inside.sum(), leakage.WINDOW_SEEDS) or it.kept[inside].sum() > leakage.WINDOW_SEEDS


def test_smith_waterman_aligns_with_gaps():
    a = np.frombuffer(b"copperjar", np.uint8)[None, :]
    b = np.full((1, 9 + 2 * leakage.BAND), 1, np.uint8)
    b[0, leakage.BAND : leakage.BAND + 10] = np.frombuffer(b"coppperjar", np.uint8)
    score, match = leakage.smith_waterman(a, np.array([9]), b)
    assert score[0] == 16 and (match[0] >= 0).all() and (np.diff(match[0]) > 0).all()


def test_pairs_under_the_least_score_are_not_traced_back():
    rng = np.random.default_rng(7)
    size = rng.integers(1, 31, 200)
    a = np.where(np.arange(30) < size[:, None], rng.integers(3, 9, (200, 30)), 0).astype(np.uint16)
    b = rng.integers(3, 9, (200, 30 + 2 * leakage.BAND)).astype(np.uint16)
    score, match = leakage.smith_waterman(a, size, b)
    score_8, match_8 = leakage.smith_waterman(a, size, b, least=8)
    assert (score == score_8).all() and 20 < (score < 8).sum() < 180
    assert (match_8[score < 8] == -1).all() and (match_8[score >= 8] == match[score >= 8]).all()
    one = [leakage.smith_waterman(a[i : i + 1], size[i : i + 1], b[i : i + 1]) for i in range(200)]
    assert (np.concatenate([s for s, _ in one]) == score).all() and (np.concatenate([m for _, m in one]) == match).all(), "whatever the lengths beside it"


def test_places_next_to_a_part_are_proposed_at_once():
    """Not one by one: parts point to up to 20 pieces each."""
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(7)) for _ in range(40)]
    it = leakage.Items([0], [" ".join(words)])
    it.choose(np.ones(len(it.keys), np.int64))
    other = lambda: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(12))
    lines = lambda at: "\n".join(x for i in range(at, at + 8, 2) for x in [*(other() for _ in range(12)), " ".join(words[i : i + 2])])
    pages = [lines(i % 32) for i in range(60)]
    calls = [0]

    def count(frame, event, arg):
        calls[-1] += event == "call"

    before = sys.getprofile()
    sys.setprofile(count)
    try:
        assert not leakage.leaks_in(it, pages)
        calls.append(0)
        assert not leakage.leaks_in(it, pages * 5)
    finally:
        sys.setprofile(before)
    assert calls[1] < 1.5 * calls[0]


# ---- languages

VOCABULARY = {
    "en": "the town council has discussed with farmers about bridge over river while rain continued and nobody was hurt this morning".split(),
    "de": "der stadtrat hat mit den bauern über die brücke gesprochen während regen weiter fiel und niemand wurde heute verletzt".split(),
    "fr": "le conseil municipal avec les paysans sur pont vieux pendant que pluie tombait personne blessé ce matin chez nous".split(),
}


def sentence(lang, n, rng):
    return [" ".join(rng.choice(VOCABULARY[lang]) for _ in range(6)) for _ in range(n)]


def test_languages(spark):
    rng = random.Random(6)
    rows = [(i, "\n".join(sentence(lang, 8, rng)), label) for i, (lang, label) in enumerate([(x, y) for x in VOCABULARY for y in (x, x.upper(), f"{x}-XX")] * 8)]
    n = len(rows)
    mixed = [x for p in zip(sentence("en", 8, rng), sentence("fr", 8, rng)) for x in p]
    rows += [
        (n, "\n".join(mixed), "eng"),
        (n + 1, "\n".join(sentence("de", 9, rng)), "en"),
        (n + 2, "\n".join(sentence("en", 9, rng) + sentence("fr", 2, rng)), "en"),
        (n + 3, "\n".join(sentence("fr", 9, rng)), None),
        (n + 4, None, "en"),
        (n + 5, "", None),
        (n + 6, "12 34\n***", "xx"),
        (n + 7, "\n".join(sentence("de", 3000, rng)), "unknown"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("words", F.lit(0)).withColumn("confidence", F.lit(0))
    models = language.fit_on(docs)
    found = language.passages(docs, models)
    got = {(r["doc_id"], r["lang"]) for r in language.unnamed(docs, found).collect()}
    assert got == {(n, "fr"), (n + 1, "de"), (n + 3, "fr"), (n + 7, "de")}
    main = {r["doc_id"]: r for r in found.where("is_main").collect()}
    assert {main[i]["lang"] for i in range(9)} == {"en", "de", "fr"} and all(0 <= r["confidence"] <= 1 for r in main.values())
    assert n + 4 not in main and n + 6 not in main
    assert language.fit_on(docs.limit(0)) is None and language.passages(docs, None).count() == 0


@pytest.mark.parametrize("advert,foreign,joined", [(2, 0, True), (3, 0, True), (9, 0, True), (3, 8, False)])
@pytest.mark.parametrize("across", [False, True])
def test_adverts_do_not_interrupt_columns_read_in_turn(advert, foreign, joined, across):
    rng = random.Random(9)
    models = language.fit([(lang, "\n".join(sentence(lang, 60, rng))) for lang in VOCABULARY for _ in range(3)])
    mine = sentence("fr", 4, rng) + ["———"] + sentence("en", advert, rng) + ["* * *"] + sentence("en", foreign, rng) + sentence("fr", 4, rng)
    other = sentence("en", len(mine), rng)
    pages = ["\n".join(f"{a}     {b}" if across else f"{a}\n{b}" for a, b in zip(mine, other)), "\n".join(mine + other)]
    found = language.detect_batch(models, pages)
    for p in range(2):
        fr = [x for x in found if x[0] == p and x[1] == "fr"]
        assert len(fr) == (1 if joined else 2) and (max(x[3] for x in fr) >= language.PASSAGE_WORDS) == joined


def test_a_passage_goes_on_where_the_other_column_ends():
    rng = random.Random(10)
    models = language.fit([(lang, "\n".join(sentence(lang, 60, rng))) for lang in VOCABULARY for _ in range(3)])
    mine = sentence("fr", 4, rng) + ["———"] + sentence("en", 5, rng) + ["* * *"] + sentence("fr", 4, rng)
    other = sentence("en", 8, rng)
    turns = [x for p in zip(mine, other) for x in p] + mine[8:]
    found = [x for x in language.detect_batch(models, ["\n".join(turns)]) if x[1] == "fr"]
    assert len(found) == 1 and found[0][3] == 48
    # an article of its own between two short passages is no advert
    text = sentence("fr", 4, rng) + sentence("en", 8, rng) + sentence("fr", 4, rng)
    assert len([x for x in language.detect_batch(models, ["\n".join(text)]) if x[1] == "fr"]) == 2


def test_model_probabilities_sum_to_one():
    m = language.fit([("en", "the cat sat on the mat\nthe dog"), ("de", "der hund und die katze")])
    words = ["the", "x", "katze", unicodedata.normalize("NFC", "über")]
    s = m.score_words(words)
    assert s.shape == (4, 2) and (s < 0).all() and s[0, m.languages.index("en")] > s[0, m.languages.index("de")]
    assert np.allclose(m.lookup(words), s, atol=1e-4)


def test_labels(spark):
    df = spark.createDataFrame([(x,) for x in ["en", "EN", "en-GB", "deu", "de_AT", "xx", "und", "unknown", "", None, " FR "]], "l string")
    assert [r["x"] for r in df.select(language.named_language(F.col("l")).alias("x")).collect()] == ["en", "en", "en", "de", "de", None, None, None, None, None, "fr"]


def _leaked(pages, items, **kw):
    from palimpsest.llm import leakage

    it = leakage.Items(list(range(len(items))), items)
    it.choose(np.zeros(len(it.keys), np.int64))
    return sorted((p, i) for p, i, _ in leakage.leaks_in(it, pages, **kw))


def test_leaks_of_near_copies_other_scripts_and_separator_characters():
    base = "the quiet ferry left harbour before seven bells while {} keepers watched amber lanterns drift along the stone pier"
    copies = [base.format(w) for w in "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()]
    assert (0, 3) in _leaked([copies[3]], copies)
    rng = np.random.default_rng(5)
    han = "".join(chr(0x4E00 + int(x)) for x in rng.integers(0, 5000, 200))
    assert _leaked(["x " + han[40:120] + " y", han[100:105]], [han]) == [(0, 0)]
    kana = " ".join("".join(chr(0x3042 + int(x)) for x in rng.integers(0, 60, 5)) for _ in range(30))
    assert _leaked([kana[20:140]], [kana]) == [(0, 0)]
    # a private-use character inside a page does not shift the pages after it
    assert _leaked(["noise  and more  noise", "before " + copies[0] + " after"], copies[:1]) == [(1, 0)]
    # letters written as one sign, and wide letters
    plain = "five fine officers find fifty fishes fitting first in fixed figures finally filed fiercely"
    assert _leaked([plain.replace("fi", "\ufb01"), "".join(chr(ord(c) + 0xFEE0) if c.isalpha() else c for c in plain)], [plain]) == [(0, 0), (1, 0)]


def test_leaves_have_trees_of_their_own_where_they_are_large(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "UPPER_LEAF", 20)
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(40, 16))
    x = centre[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, 16)) * 0.4
    df = spark.createDataFrame([(f"v{i:04d}", [float(v) for v in r]) for i, r in enumerate(x)], "id string, embedding array<float>")
    row = neighbours.measured(df, 16, 5, 0.97, fit_rows=100).first()
    assert row["queries"] > 900 and row["recall"] >= 0.93
    found = neighbours.neighbours(df, 16, 5, recall=0.97, fit_rows=100)
    assert found.groupBy("rec").count().where("count > 5").count() == 0


def test_leaves_stay_small_at_a_billion_rows():
    from palimpsest.operators.ann import fit_tree

    rng = np.random.default_rng(4)
    x = rng.normal(size=(20_000, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    upper = fit_tree(x, 10**9)
    lower = fit_tree(x, 10**9 // upper.leaves)
    assert 10**9 / (upper.leaves * lower.leaves) <= 1_000


def test_too_few_true_pairs_do_not_open_all_leaves(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(4000, 16))
    df = spark.createDataFrame([(f"v{i:04d}", [float(v) for v in r]) for i, r in enumerate(x)], "id string, embedding array<float>")
    seen = []
    real = neighbours._widening
    neighbours._widening = lambda *a: seen.append(real(*a)) or seen[-1]
    try:
        assert neighbours.neighbours(df, 16, 5, least=0.999).count() == 0
    finally:
        neighbours._widening = real
    assert seen and seen[0] < float("inf")


def test_of_overlapping_spans_the_longest_stands_and_the_rest_is_kept():
    from palimpsest.llm import personal

    spans = [(0, "aaaaa", "phone"), (4, "b" * 16, "address"), (10, "ccccc", "phone"), (30, "dd", "email")]
    assert personal.disjoint(spans) == [spans[1], spans[3]]
    assert personal.disjoint([(0, "abcde", "x"), (4, "e", "y"), (10, "fghij", "z")]) == [(0, "abcde", "x"), (10, "fghij", "z")]
    assert personal.disjoint([(5, "bbb", "x"), (0, "aaa", "x"), (5, "bbb", "x")]) == [(0, "aaa", "x"), (5, "bbb", "x")]


def test_redaction_replaces_where_the_span_stands(spark):
    from palimpsest.llm import personal

    text = 'café "12345678" \U0001f600 order 99123456781, again 12345678'
    at = text.index("12345678")
    last = text.rindex("12345678")
    spans = [(at, "12345678", "phone"), (last, "12345678", "phone")]
    want = 'café "<PHONE>" \U0001f600 order 99123456781, again <PHONE>'
    for payload in (json.dumps(text), json.dumps(text, ensure_ascii=False), " " + json.dumps({"role": "12345678", "content": text, "turn": [1, "x"]}), json.dumps({"content": text, "z": "12345678"}, ensure_ascii=False)):
        out = personal.spliced(payload, text, spans)
        assert json.loads(out) == (want if isinstance(json.loads(payload), str) else {**json.loads(payload), "content": want})
        assert len(payload) - len(out) == 2
    assert personal.spliced(text, text, spans) == want
    assert personal.spliced(json.dumps({"content": {"tel": "12345678"}}), '{"tel":"12345678"}', [(8, "12345678", "phone")]).count("12345678") in (0, 1)
    rows = spark.createDataFrame([("a", json.dumps("call 12345678 now")), ("a", "other"), ("b", None), ("c", "")], ATOM)
    found = spark.createDataFrame([("call 12345678 now", 5, "12345678", "phone")], "t string, start int, span string, kind string").select(F.md5("t").alias("digest"), "start", "span", "kind")
    got = sorted(((r["id"], r["redacted"]) for r in personal.redacted(rows, found).collect()), key=str)
    assert got == sorted([("a", '"call <PHONE> now"'), ("a", "other"), ("b", None), ("c", "")], key=str)


def test_words_before_a_place_have_no_window():
    from palimpsest.llm import personal

    text = "passport " + "x" * 300 + " " + "y" * 400 + " " + "z" * 50 + " 12345678"
    assert [len(w) for w in personal._cue_words(text, text.index("12345678"))] == [300, 400, 50]
    assert personal._name_anchors("Dr. " + " " * 200 + "Anna Berg left") == ["anna", "berg"]


def test_repeated_ids_are_separate_records(spark):
    df = spark.createDataFrame([("3", "hello"), ("3", "world"), ("4", "hello"), ("5", "x y"), ("5", "x y"), ("5", "X-Y")], ATOM)
    classes = identical.formatting_classes(df)
    assert sorted((r["rec"], r["class_id"], r["class_size"]) for r in classes.collect()) == [("3", "3", 1), ("3", "3", 2), ("4", "3", 2), ("5", "5", 3), ("5", "5", 3), ("5", "5", 3)]
    assert pair_set(identical.pairs_within(classes)) == {("3", "4")}
    assert sorted((r["class_id"], r["copies"]) for r in identical.collapsed(classes).collect()) == [("3", 1), ("3", 2), ("5", 3)]


def test_fields_inside_a_value_stand_in_any_order(spark):
    rows = [("a", '{"a":{"x":1,"y":[2,{"p":"Q","r":3}]},"b":2}'), ("b", '{"b": 2, "A": {"Y":[2,{"r":3,"P":"q"}], "X": 1}}'), ("c", '{"b":2,"a":{"x":1,"y":[2,{"p":"Q","r":4}]}}'), ("d", '{"a":"{not json","b":2}')]
    df = spark.createDataFrame(rows, ATOM)
    assert pair_set(identical.pairs_within(identical.formatting_classes(df))) == {("a", "b")}
    keys = {r["id"]: bytes(r["k"]) for r in df.select("id", identical.formatting_key(F.col("payload")).alias("k")).collect()}
    assert keys["a"] == keys["b"] and len(set(keys.values())) == 3


def test_an_opposing_score_keeps_its_loading(spark):
    rows = [("q", f"i{i:02d}", float(i), float(i * i), float(-i) + (i % 3)) for i in range(40)]
    df = spark.createDataFrame(rows, "query_id string, atom_id string, a double, b double, c double")
    got = {r["score"]: (r["loading"], r["agrees"]) for r in ranking.loadings(df, "query_id", "atom_id", ["a", "b", "c"]).collect()}
    assert got["a"][0] > 0.5 and got["b"][0] > 0.5 and got["c"][0] < -0.5 and [got[s][1] for s in "abc"] == [True, True, False]
    assert ranking.heads(df, "query_id", "atom_id", ["a", "b", "c"], 40).count() == 40
    assert {r["atom_id"] for r in ranking.heads(df, "query_id", "atom_id", ["a", "b"], 3).collect()} == {"i39", "i38", "i37"}
    placed = {r["atom_id"]: r["position"] for r in ranking.fused_ranking(df, "query_id", "atom_id", ["a", "b", "c"]).collect()}
    assert {placed[i] for i in ("i39", "i38", "i37")} == {1, 2, 3}


def _made_up(seed, letters, n=60):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randint(3, 9))) for _ in range(n)]


def test_languages_come_from_the_labels(spark):
    """Any language that labels name often enough; a label that explains nothing of its own is none; strange stretches are rejected."""
    rng = random.Random(8)
    words = {"pt": _made_up(1, "aeiouãçlmnrst"), "pl": _made_up(2, "aeoyłżśćkwzr"), "en": _made_up(3, "aeiothndrsyw")}
    page = lambda lang, n=8: "\n".join(" ".join(rng.choice(words[lang]) for _ in range(6)) for _ in range(n))
    rows = [(lang, page(lang)) for lang in words for _ in range(24)]
    labels = {"pt": ["pt", "por", "PT-br"], "pl": ["pl", "pol", "PL"], "en": ["en", "eng", "en_GB"]}
    rows = [(i, text, labels[lang][i % 3]) for i, (lang, text) in enumerate(rows)]
    rows += [(100 + i, page("en"), "sv") for i in range(12)]  # wrong labels
    strange = "\n".join(" ".join("".join(rng.choice("ξψωφβγδ") for _ in range(6)) for _ in range(6)) for _ in range(8))
    rows += [(200, page("pt"), "pl"), (201, page("pl"), None), (202, page("en", 6) + "\n" + strange + "\n" + page("en", 6), "xx"), (203, page("en"), "xx"), (204, page("en"), "fi")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = language.fit_on(docs)
    assert models.languages == ["en", "pl", "pt"] and models.reject < 20
    found = language.passages(docs, models)
    got = {(r["doc_id"], r["lang"]) for r in language.unnamed(docs, found).collect()}
    assert got == {(200, "pt"), (201, "pl"), (202, "en"), (203, "en"), (204, "en")} | {(100 + i, "en") for i in range(12)}
    mixed = {(r["lang"], r["first_line"]) for r in found.where("doc_id = 202").collect()}
    assert ("und", 6) in mixed and ("en", 0) in mixed
