"""Consistent form, same-reading pairs and leaked passages against brute force."""

import random
import unicodedata

import pytest

from tidewheel.llm.leaks import PassageIndex, align, find_leaks
from tidewheel.llm.same_reading import consistent_texts, reading_classes, same_reading_pairs
from tidewheel.llm.text_form import CYRILLIC, GREEK, LATIN_FOR_CYRILLIC, LATIN_FOR_GREEK, Transducer, consistent_form, transducer, words


@pytest.mark.parametrize(
    "stored,form",
    [
        ("", ""), ("plain text", "plain text"), ("Ｆｕｌｌ　ｗｉｄｔｈ！", "Full width!"), ("ﬁne ﬂow oﬀer", "fine flow offer"), ("été", "été"), ("ậ", "ậ"), ("ậ", "ậ"),
        ("zero​wid­th﻿", "zerowidth"), ("a b c　d\te", "a b c d e"), ("x\r\ny\rz w", "x\ny\nz\nw"), ("Аррӏе", "Apple"), ("Οld οf", "Old of"),
        ("е́", "é"), ("ό", "ó"), ("ё", "ë"), ("Ａ́", "Á"), ("e​́", "é"), ("한", "한"), ("\U0001d400b", "Ab"), ("m² … —", "m² … —"),
        ("́x", "́x"), ("\ńx", "\ńx"), ("  two  ", "  two  "), ("Straße œuvre", "Straße œuvre"),
    ],
)
def test_forms(stored, form):
    assert consistent_form(stored) == form
    assert consistent_form(form) == form


def test_null_and_idempotence():
    assert consistent_form(None) is None
    r = random.Random(1)
    alphabet = [chr(c) for c in [*range(0x20, 0x250), *range(0x300, 0x370), *range(0x370, 0x530), *range(0x1100, 0x1120), *range(0x2000, 0x2070), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF60), 0x1D400, 0x1F600, *range(0x1161, 0x1176), *range(0x11A8, 0x11B0), 0xFFA0, 0x845B, 0xE0100, 0xFE0E, 0xFE0F, 0x1F468, 0x1F3FB, 0x0915, 0x094D, 0x0645, 0x06CC, 0x180B]]
    for _ in range(2000):
        t = "".join(r.choices(alphabet, k=r.randint(0, 12)))
        f = consistent_form(t)
        assert consistent_form(f) == f, (t, f)
        # whether a form is stored composed or decomposed doesn't matter
        assert consistent_form(unicodedata.normalize("NFD", f)) == consistent_form(unicodedata.normalize("NFC", f))


def test_tables_are_aligned_and_free_of_conflicts():
    assert len(CYRILLIC) == len(LATIN_FOR_CYRILLIC) and len(GREEK) == len(LATIN_FOR_GREEK)
    Transducer()  # raises on a conflict
    assert transducer() is transducer()


@pytest.mark.parametrize(
    "stored,form",
    [
        ("\u03bd\u03b1\u03c1\u03c5", "vapu"), ("\u0585\u0555", "oO"), ("\u13aa\u13df", "AC"), ("\u2c9f", "o"), ("\u0251\u0261", "ag"), ("\u017ft\ufb06", "stst"), ("\u2163", "IV"), ("\u0474", "V"),
        ("\u0131", "\u0131"),  # two letters of one script stay apart
        ("a\u200cb\u200dc\ufe0f", "abc"), ("\u200d", ""), ("e\u200d\u0301", "\xe9"), ("\u1112\u200d\u1161", "\ud558"), ("e\u00ad\u0323\u0302", "\u1ec7"), ("\xea\u0323", "\u1ec7"), ("\u0430\u0302\u0301", "\u1ea5"),
        ("q\u0307\u0323", "q\u0323\u0307"),  # accents without a composed letter are put in order
    ],
)
def test_look_alikes_and_characters_without_width(stored, form):
    assert consistent_form(stored) == form
    assert consistent_form(form) == form


@pytest.mark.parametrize(
    "shown,other",
    [
        ("\U0001f468\u200d\U0001f469\u200d\U0001f467", "\U0001f468\U0001f469\U0001f467"),  # one family, three people
        ("\u0600\u06dd", ""), ("\u263a\ufe0f", "\u263a"), ("\u263a\ufe0f", "\u263a\ufe0e"), ("1\ufe0f\u20e3", "1\u20e3"),
        ("\u0645\u06cc\u200c\u062e\u0648\u0627\u0647\u0645", "\u0645\u06cc\u062e\u0648\u0627\u0647\u0645"), ("\u0915\u094d\u200d\u0937", "\u0915\u094d\u0937"),
        ("\u845b\U000e0100", "\u845b"), ("\U0001f3f4\U000e0067\U000e007f", "\U0001f3f4"),
    ],
)
def test_what_shows_is_kept(shown, other):
    assert consistent_form(shown) == shown and consistent_form(other) == other


def test_longest_match_and_conflicts(monkeypatch):
    from tidewheel.llm import text_form

    t = transducer()
    assert t._match("a\u0302\u0301x", 0) == (3, "\u1ea5") and t._match("a\u0302\u0303x", 0)[0] == 3 and t._match("\r\nx", 0) == (2, "\n") and t._match("\rx", 0) == (1, "\n") and t._match("x", 0) == (1, "x")
    monkeypatch.setitem(text_form.ALIKE, "Greek", ("AB", "\u0391\u0410"))  # Cyrillic A again, as B
    with pytest.raises(text_form.Conflict):
        Transducer()
    monkeypatch.setitem(text_form.ALIKE, "Greek", ("AA", "\u0391\u0392"))  # two letters of a script fall together
    with pytest.raises(text_form.Conflict):
        Transducer()


def test_stored_orders_of_accents_do_not_matter():
    from itertools import permutations

    r = random.Random(2)
    composed = [chr(c) for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0x1F00, 0x1FFE)] if unicodedata.normalize("NFC", chr(c)) == chr(c)]
    for _ in range(1500):
        parts = unicodedata.normalize("NFD", r.choice(composed))
        want = consistent_form(parts)
        for marks in permutations(parts[1:]):
            if unicodedata.normalize("NFD", parts[0] + "".join(marks)) == parts:
                assert consistent_form("x" + parts[0] + "".join(marks) + "y") == "x" + want + "y"


def test_words():
    assert words("It's 12,5 % of Ünder_score—Äh") == ["it", "s", "12", "5", "of", "ünder", "score", "äh"]


def test_very_long_text():
    t = "é а" * 400_000
    assert consistent_form(t) == "é a" * 400_000


def test_pairs_and_classes(spark):
    rows = [(1, "café of"), (2, "café of"), (3, "café οf"), (4, "café of"), (5, "Café of"), (6, None), (7, ""), (8, "​"), (9, "café  of"), (None, "x")]
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id bigint, text string, form string")
    got = {tuple(r) for r in same_reading_pairs(df, "doc_id", "text").collect()}
    assert got == {(1, 2), (1, 3), (2, 3), (2, 4), (3, 4), (7, 8)}
    classes = {r["doc_id"]: (r["class"], r["n_alike"], r["n_stored"]) for r in reading_classes(df, "doc_id", "text").where("doc_id is not null").collect()}
    assert classes[4] == (1, 4, 3) and classes[5] == (5, 1, 1) and 6 not in classes and classes[8] == (7, 2, 2)
    forms = {r["doc_id"]: (r["form"], r["n_changed"]) for r in consistent_texts(df, "doc_id", "text").where("doc_id is not null").collect()}
    assert forms[2] == ("café of", 1) and forms[6] == (None, None) and forms[7] == ("", 0) and forms[1][1] == 0
    for f in (same_reading_pairs, reading_classes, consistent_texts):
        assert f(df.limit(0), "doc_id", "text").count() == 0


def test_many_copies_make_no_pairs(spark):
    df = spark.createDataFrame([(i, "same text") for i in range(3000)] + [(5000, "same text")], "doc_id bigint, text string")
    assert same_reading_pairs(df, "doc_id", "text").count() == 3000


VOCABULARY = [f"w{i}" for i in range(400)]


def corpus(seed):
    r = random.Random(seed)
    items = [(i, " ".join(r.choices(VOCABULARY, k=r.choice([5, 14, 30, 45])))) for i in range(25)]
    items += [(100, items[3][1]), (101, ""), (102, None), (None, items[3][1]), (103, "the same words " * 8)]
    docs = []
    for d in range(120):
        t = r.choices(VOCABULARY, k=r.randint(0, 150))
        if r.random() < 0.6:
            p = r.choice([x for _, x in items if x and len(x.split()) > 5]).split()
            a = r.randint(0, len(p) - 5)
            t[len(t) // 2 : len(t) // 2] = p[a : a + r.randint(5, 40)]
        text = " ".join(t)
        if r.random() < 0.3:
            text = text.replace("w1", "ｗ１").replace(" ", " ", 3).replace("2", "2​", 5).upper()
        docs.append((d, text))
    docs += [(500, None), (501, ""), (502, "the same words " * 50), (502, "the same words " * 50), (None, items[3][1])]
    return docs, items


def shared(docs, items, k=12):
    grams = {}
    for i, p in items:
        if i is not None and p:
            w = words(consistent_form(p))
            for a in range(len(w) - k + 1):
                grams.setdefault(tuple(w[a : a + k]), set()).add(i)
    out = set()
    for d, t in docs:
        if d is not None and t:
            w = words(consistent_form(t))
            for a in range(len(w) - k + 1):
                out |= {(d, i) for i in grams.get(tuple(w[a : a + k]), ())}
    return out


@pytest.mark.parametrize("seed,block,chunk", [(1, 10**6, 1 << 18), (2, 40, 200)])
def test_leaks_equal_brute_force(spark, monkeypatch, seed, block, chunk):
    from tidewheel.llm import leaks

    monkeypatch.setattr(leaks, "BLOCK_WORDS", block)
    monkeypatch.setattr(leaks, "CHUNK", chunk)
    docs, items = corpus(seed)
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id bigint, text string, words string").repartition(3)
    e = spark.createDataFrame([(i, p, 1) for i, p in items], "item_id bigint, passage string, doc int")
    got = find_leaks(d, "doc_id", "text", e, "item_id", "passage")
    rows = got.collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows if r["longest_run"] >= 12} == shared(docs, items)
    assert len({(r["doc_id"], r["item_id"]) for r in rows}) == len(rows)


def test_edited_copy_is_found(spark):
    r = random.Random(3)
    p = r.choices(VOCABULARY, k=40)
    copy = p[:8] + ["inserted"] + p[8:16] + ["changed"] + p[17:26] + ["changed"] + p[27:36] + ["changed"]
    d = spark.createDataFrame([(1, "before " + " ".join(copy) + " after"), (2, " ".join(r.choices(VOCABULARY, k=200)))], "doc_id bigint, text string")
    e = spark.createDataFrame([(7, " ".join(p))], "item_id bigint, passage string")
    got = find_leaks(d, "doc_id", "text", e, "item_id", "passage").collect()
    assert [(x["doc_id"], x["item_id"]) for x in got] == [(1, 7)] and got[0]["longest_run"] < 12 and got[0]["score_share"] > 0.8


def edited(r, p):
    """A copy with a word changed, inserted or left out after every 7 to 11 words."""
    out, at = [], 0
    while at < len(p):
        k = r.randint(7, 11)
        out += p[at : at + k]
        at += k
        new, skipped = r.choice([(["changed"], 1), (["inserted"], 0), ([], 1)])
        out += new
        at += skipped
    return out


@pytest.mark.parametrize("exact", [0, 1, 3])
def test_copies_edited_throughout_are_found_beside_exact_ones(spark, exact):
    r = random.Random(4)
    items = {i: [f"p{i}x{j}" for j in range(70)] for i in range(3)}
    docs = {100 * i + k: r.choices(VOCABULARY, k=60) + (edited(r, p) if k else p) + r.choices(VOCABULARY, k=60) for i, p in items.items() for k in [0] * bool(exact) + [1, 2, 3]}
    docs |= {1000 + 100 * i + k: p for i, p in items.items() for k in range(exact - 1)}
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in docs.items()], "doc_id bigint, text string").repartition(3)
    e = spark.createDataFrame([(i, " ".join(p)) for i, p in items.items()], "item_id bigint, passage string")
    got = {(x["doc_id"], x["item_id"]): x for x in find_leaks(d, "doc_id", "text", e, "item_id", "passage").collect()}
    assert set(got) == {(k, k % 1000 // 100) for k in docs}
    assert all(x["longest_run"] < 12 and 0.5 <= x["score_share"] < 1 for (k, _), x in got.items() if k % 100 in (1, 2, 3) and k < 1000)


def test_every_alignment_of_half_a_passage_comes_out(spark):
    r = random.Random(5)
    items = {i: r.choices(VOCABULARY[:150], k=r.randint(12, 40)) for i in range(8)}
    docs = {}
    for k in range(60):
        p = edited(r, items[r.randrange(8)])
        a = r.randint(0, len(p) // 2)
        docs[k] = r.choices(VOCABULARY[:150], k=20) + p[a : a + r.randint(6, 40)] + r.choices(VOCABULARY[:150], k=20)
    grams = lambda w: {tuple(w[a : a + 4]) for a in range(len(w) - 3)}
    wanted = {(k, i) for k, t in docs.items() for i, p in items.items() if grams(t) & grams(p) and plain_alignment(p, t) >= len(p)}
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in docs.items()], "doc_id bigint, text string")
    e = spark.createDataFrame([(i, " ".join(p)) for i, p in items.items()], "item_id bigint, passage string")
    rows = find_leaks(d, "doc_id", "text", e, "item_id", "passage").collect()
    assert {(x["doc_id"], x["item_id"]) for x in rows if x["score_share"] >= 0.5} == wanted and len(wanted) > 20


def test_empty_sides(spark):
    d, e = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string"), spark.createDataFrame([(1, "a b c d e f g")], "item_id bigint, passage string")
    assert find_leaks(d.limit(0), "doc_id", "text", e, "item_id", "passage").count() == 0
    assert find_leaks(d, "doc_id", "text", e.limit(0), "item_id", "passage").count() == 0


def plain_alignment(p, w):
    score = [[0] * (len(w) + 1) for _ in range(len(p) + 1)]
    best = 0
    for i, a in enumerate(p, 1):
        for j, b in enumerate(w, 1):
            score[i][j] = max(0, score[i - 1][j - 1] + (2 if a == b else -1), score[i - 1][j] - 1, score[i][j - 1] - 1)
            best = max(best, score[i][j])
    return best


def test_alignment_equals_plain_dynamic_programme():
    import numpy as np

    r = random.Random(0)
    for _ in range(30):
        p = [r.randint(1, 5) for _ in range(r.randint(1, 12))]
        ws = [[r.randint(0, 5) for _ in range(15)] for _ in range(4)]
        best, run = align(np.array(p, np.int32), np.array(ws, np.int32))
        assert best.tolist() == [plain_alignment(p, w) for w in ws]
        for w, n in zip(ws, run.tolist()):
            subs = {tuple(p[a:b]) for a in range(len(p)) for b in range(a + 1, len(p) + 1)}
            assert n == max((b - a for a in range(15) for b in range(a + 1, 16) if tuple(w[a:b]) in subs), default=0)


def test_seeds_are_all_grams_and_whole_short_passages():
    import numpy as np

    index = PassageIndex([(1, "a b c d e f g h"), (2, "x y z"), (3, "c d e f g h q"), (4, "")], 6)
    assert index.sizes == [3, 6] and len(index.passages) == 3
    ids = np.array([index.vocabulary.get(w, 0) for w in "o x y z o c d e f g h x y".split()], np.int32)
    at, size, passages = index.hits(ids, np.cumsum(np.r_[0, ids > 0]), np.array([13]))
    assert list(zip(at.tolist(), size.tolist(), map(tuple, passages))) == [(1, 3, (1,)), (5, 6, (0, 2))]
    # a seed doesn't reach over the end of a text
    assert len(index.hits(ids, np.cumsum(np.r_[0, ids > 0]), np.array([3, 10, 13]))[0]) == 0


def test_words_in_order_bound_every_alignment():
    r = random.Random(6)
    for _ in range(60):
        p, w = ([r.choice("abcdef") for _ in range(r.randint(1, 90))] for _ in range(2))
        index = PassageIndex([(1, " ".join(p))], 4)
        table = [[0] * (len(w) + 1) for _ in range(len(p) + 1)]
        for i, a in enumerate(p):
            for j, b in enumerate(w):
                table[i + 1][j + 1] = table[i][j] + 1 if a == b else max(table[i][j + 1], table[i + 1][j])
        got = index.in_order(0, [index.vocabulary.get(x, 0) for x in w])
        assert got == table[-1][-1] and 2 * got >= plain_alignment(p, w)


def test_short_passage_is_found_whole(spark):
    d = spark.createDataFrame([(1, "so Bright a day"), (2, "bright day"), (3, "ends bright a"), (4, "bright a day bright a day")], "doc_id bigint, text string")
    e = spark.createDataFrame([(7, "bright a day"), (8, "..."), (9, "day")], "item_id bigint, passage string")
    got = {(x["doc_id"], x["item_id"]): (x["longest_run"], x["score_share"]) for x in find_leaks(d, "doc_id", "text", e, "item_id", "passage").collect()}
    assert got == {(1, 7): (3, 1.0), (4, 7): (3, 1.0), (1, 9): (1, 1.0), (2, 9): (1, 1.0), (4, 9): (1, 1.0)}


@pytest.mark.parametrize("every", [4, 5, 7, 8, 10, 11])
def test_recall_on_edited_copies(spark, every):
    """Against Smith-Waterman over whole texts: copies in which every so many words one is changed, inserted or left out, none with 12 words unbroken."""
    r = random.Random(every)
    items = {i: r.choices(VOCABULARY, k=r.randint(25, 60)) for i in range(6)}
    docs = {}
    for k in range(48):
        p, out, at = items[k % 6], [], 0
        while at < len(p):
            out += p[at : at + every]
            at += every
            new, skipped = ((["changed"], 1), (["inserted"], 0), ([], 1))[r.randrange(3)]
            out += new
            at += skipped
        docs[k] = r.choices(VOCABULARY, k=30) + out + r.choices(VOCABULARY, k=30)
    assert all(plain_run(items[k % 6], t) < 12 + 2 for k, t in docs.items())
    wanted = {(k, i) for k, t in docs.items() for i, p in items.items() if plain_alignment(p, t) >= len(p)}
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in docs.items()], "doc_id bigint, text string")
    e = spark.createDataFrame([(i, " ".join(p)) for i, p in items.items()], "item_id bigint, passage string")
    got = {(x["doc_id"], x["item_id"]) for x in find_leaks(d, "doc_id", "text", e, "item_id", "passage").collect()}
    assert len(wanted) >= 48 and len(got & wanted) >= 0.9 * len(wanted)


def plain_run(p, w):
    grams = lambda x, k: {tuple(x[a : a + k]) for a in range(len(x) - k + 1)}
    return max((k for k in range(1, len(p) + 1) if grams(p, k) & grams(w, k)), default=0)
