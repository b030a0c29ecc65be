from __future__ import annotations

import itertools
import math
import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairaudit.llm import leakage, lookalike, packing
from pairaudit.llm.lookalike import canonical

SAME = [
    ("café", "café"),
    ("ＡＢＣ１", "ABC1"),
    ("a b　c\td", "a b c d"),
    ("so­ft​﻿⁠", "soft"),
    ("аеорс", "aeopc"),
    ("ё", "ë"),
    ("ﬁt ﬂy", "fit fly"),
    ("Å K µ", "Å K μ"),
    ("x‑y‐z", "x-y-z"),
    ("a\r\nb c\rd", "a\nb\nc\nd"),
    ("e​́", "é"),
    ("가", "가"),
    ("ｶﾞ", "ガ"),
]
DIFFERENT = [("10⁴", "104"), ("R²", "R2"), ("naïve", "naive"), ("a  b", "a b"), ("The", "the"), ("Å", "A"), ("M⁻¹", "M-1"), ("a\nb", "a b"), ("x", "x ")]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same_look(a, b):
    assert canonical(a) == canonical(b)
    assert canonical(f"q{a}q") == canonical(f"q{b}q")


@pytest.mark.parametrize(("a", "b"), DIFFERENT)
def test_different_look(a, b):
    assert canonical(a) != canonical(b)


MIXED = st.text(st.one_of(st.sampled_from("ae é̈​éａа\r\n\t각゙ｶﬁ "), st.characters(exclude_categories=("Cs",))), max_size=40)


@settings(max_examples=400)
@given(MIXED)
def test_splicing_equals_normalising_the_whole(text):
    whole = lookalike._form(text)
    assert canonical(text) == whole
    assert canonical(whole) == whole
    assert unicodedata.is_normalized("NFC", whole)


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id bigint, text string, look string, item_id int")


def test_pairs_and_classes(spark):
    rows = [(1, "café"), (2, "café"), (3, "café"), (4, "cafe"), (5, None), (6, ""), (7, "​"), (8, "﻿"), (2, "café"), (None, "café")]
    df = documents(spark, rows)
    got = sorted(map(tuple, lookalike.lookalike_pairs(df, "doc_id", "text").collect()))
    assert got == [(1, 2), (2, 3), (7, 8)]
    classes = {r.doc_id: (r.class_id, r.n_texts, r.n_spellings) for r in lookalike.lookalike_classes(df, "doc_id", "text").collect()}
    assert classes == {1: (1, 3, 2), 2: (1, 3, 2), 3: (1, 3, 2), 7: (7, 2, 2), 8: (7, 2, 2)}
    out = lookalike.canonical_texts(df.filter("doc_id > 3"), "doc_id", "text")
    assert out.columns == ["doc_id", "text", "skeleton"]
    assert {r.doc_id: r.text for r in out.collect()} == {r.doc_id: r.skeleton for r in out.collect()} == {4: "cafe", 5: None, 6: "", 7: "", 8: ""}
    assert lookalike.lookalike_pairs(df.limit(0), "doc_id", "text").count() == 0


@pytest.fixture(scope="module")
def wide(spark):
    return lookalike.confusables(spark)


def test_confusables_are_letters_of_the_same_case(wide):
    assert len(wide) > 300
    for c, x in wide.items():
        assert len(x) == 1 and x.isascii() and x.isalpha() and not c.isascii()
        assert c.isupper() <= x.isupper() and (not c.islower() or x.islower())


ODD = [("𝐛old", "bold"), ("ρad", "pad"), ("αlpha", "alpha"), ("Ꮪet", "Set"), ("ɑbc", "abc"), ("ɡo", "go"), ("cօpy", "copy"), ("ꓐig", "Big"), ("κit", "κit"), ("сору", "copy"), ("ρ́ad", "ṕad"), ("άd", "ád"), ("Zβα", "Zβa"), ("éα", "éa")]


@pytest.mark.parametrize(("odd", "plain"), ODD)
def test_confusables(wide, odd, plain):
    assert canonical(odd, wide) == canonical(plain, wide)
    assert canonical(canonical(odd, wide), wide) == canonical(odd, wide)


@pytest.mark.parametrize(("a", "b"), [*DIFFERENT, ("α-cyclodextrin", "a-cyclodextrin"), ("σ", "o"), ("10", "lO"), ("m", "rn"), ("I", "l"), ("3", "З"), ("sıra", "sira")])
def test_what_a_reader_tells_apart(wide, a, b):
    assert canonical(a, wide) != canonical(b, wide)


def test_readable_text_keeps_words_of_other_scripts(wide):
    for text in ("Москва сорока", "αβγ и ρ", "می\u200cخواهم", "👩\u200d🔬 ❤\ufe0f", "क्\u200dष"):
        assert lookalike.readable(text, lookalike.with_lookalikes(wide)) == text
    assert lookalike.readable("pаss ＡB\u200bc ρad", lookalike.with_lookalikes(wide)) == "pass ABc pad"
    assert canonical("Москва", wide) == canonical("Mocквa", wide)


@settings(max_examples=200, deadline=None)
@given(text=MIXED)
def test_the_key_sees_no_difference_in_the_readable_text(wide, text):
    assert canonical(lookalike.readable(text, lookalike.with_lookalikes(wide)), wide) == canonical(text, wide)


@settings(max_examples=300, deadline=None)
@given(text=st.text(st.sampled_from("abZé αγβτгьтρ́ά1²_-\n"), max_size=30))
def test_words_fold_alike_wherever_they_stand(wide, text):
    runs = ["".join(run) for _, run in itertools.groupby(text, key=lookalike._in_word)]
    assert wide.folded(text, wide.letters & set(text)) == "".join(wide.word(r) if wide.letters & set(r) else r for r in runs)


def test_many_copies_of_two_spellings(spark):
    df = documents(spark, [(i, "café" if i % 2 else "cafe\u0301") for i in range(60)])
    assert lookalike.lookalike_pairs(df, "doc_id", "text").count() == 30 * 30


def test_very_long_text(spark):
    long = "word café Ａ " * 40_000
    df = documents(spark, [(1, long), (2, long.replace("é", "é"))])
    assert lookalike.lookalike_pairs(df, "doc_id", "text").count() == 1


# leakage


def brute(docs, items, share=0.5):
    found = set()
    for i, t in items:
        w = leakage.words_of(t)
        n = leakage.run_length(len(w), share)
        runs = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
        for d, x in docs:
            v = leakage.words_of(x)
            if any(tuple(v[k : k + n]) in runs for k in range(len(v) - n + 1)):
                found.add((d, i))
    return found


def leaks(spark, docs, items, **kw):
    it = spark.createDataFrame([(i, t, "s", 1) for i, t in items], "item_id bigint, text string, suite string, code int")
    return {tuple(r) for r in leakage.find_leaks(documents(spark, docs), it, **kw).collect()}


def test_words():
    assert leakage.words_of("The 10⁴ M⁻¹, Ａlpha-B​eta_c.") == ["the", "10⁴", "m", "¹", "alpha", "beta", "c"]
    assert leakage.words_of(None) == leakage.words_of("") == leakage.words_of(" .,") == []


@pytest.mark.parametrize("hidden", ["\0", "\x7f", "\x01"])
def test_controls_split_no_word(spark, hidden):
    assert leakage.words_of(f"mexthe{hidden}rene\tis\nflat") == ["mextherene", "is", "flat"]
    assert leaks(spark, [(1, f"x the sa{hidden}lt of water y")], [(5, "the salt of water")]) == {(1, 5)}


def test_leaks_against_brute_force(spark):
    rng = random.Random(9)
    vocabulary = "the salt of a host and 12 3.5 mextherene kd 980 k mol water".split()
    item = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, item(rng.randint(1, 30))) for i in range(40)] + [(90, None), (91, ""), (92, "..."), (0, item(4))]
    docs = [(d, item(rng.randint(1, 200))) for d in range(60)] + [(70, None), (71, "")]
    for d in range(100, 130):
        w = leakage.words_of(items[rng.randint(0, 39)][1])
        n = leakage.run_length(len(w), 0.5) - rng.randint(0, 1)
        s = rng.randint(0, len(w) - n) if n else 0
        docs.append((d, "zzz " + " ".join(w[s : s + n]).upper() + " zzz"))
    docs += docs[:3]
    want = brute(docs, [x for x in items if x[1]])
    assert leaks(spark, docs, items) == want
    assert len(want) > 40


def test_look_alikes_do_not_hide_a_leak(spark):
    text = "Binding of mextherene to a host gave log K at 309.0 K"
    hidden = text.replace("a", "а").replace(" ", " ").replace("host", "ho​st").replace("K", "K")
    assert leaks(spark, [(1, f"x {hidden} y")], [(5, text)]) == {(1, 5)}


ORDINARY = "binding of to gave log at and stayed flat the melts water heat in then cool for with salt a host".split()
TEMPLATES = leakage.Templates(frozenset(ORDINARY))


def test_templates():
    of = TEMPLATES.of
    assert [of(w) for w in ("of", "mextherene", "12", "10⁴", "kj", "kcal", "mg", "seconds", "tv", "as", "k", "µm")] == [
        "of", "<name>", "<number>", "<number>", "<unit:energy>", "<unit:energy>", "<unit:g>", "<unit:time>", "<name>", "<name>", "<unit:temperature>", "<unit:m>"]


def test_ordinary_words_are_counted_over_all_documents(spark):
    docs = spark.createDataFrame([(i, f"The salt melts, the salt of name{i} {'rare' if i < 3 else ''}") for i in range(100)] + [(200, None), (201, "")], "id int, t string")
    items = spark.createDataFrame([(1, "salt of name7 melts rare unseen"), (2, None)], "id int, t string")
    assert leakage.ordinary_words(docs, items, 0.05) == {"salt", "melts", "of"}
    assert leakage.ordinary_words(docs, items, 0.02) == {"salt", "melts", "of", "rare"}


def test_other_parameters(spark):
    item = "Binding of mextherene to water gave log K 5.96 at 309.0 K and mextherene stayed flat"
    docs = [
        (1, item.replace("mextherene", "kavalione").replace("5.96", "8.10")),
        (2, item.replace("mextherene", "kavalione", 1)),  # one name became two
        (3, item),
        (4, "nothing of the kind"),
    ]
    assert leaks(spark, docs, [(7, item)], slots="consistent", share=1.0, ordinary=ORDINARY) == {(1, 7), (3, 7)}
    assert leaks(spark, docs, [(7, item)], share=1.0, ordinary=ORDINARY) == {(3, 7)}


# what is and what is not the same question with other parameters
ASKED_AGAIN = [
    ("heat 9 kj in 4 h of water then cool the salt", "heat 7 kcal in 5 min of water then cool the salt", True),
    ("heat 9 kj in 4 h of water then cool the salt", "heat 5 mg in 3 ml of water then cool the salt", False),
    ("cool the salt to 3 and the host to 3 and stayed flat", "cool the salt to 4 and the host to 4 and stayed flat", True),
    ("cool the salt to 3 and the host to 3 and stayed flat", "cool the salt to 4 and the host to 9 and stayed flat", False),
    ("cool the salt to 3 and the host to 8 and stayed flat", "cool the salt to 4 and the host to 4 and stayed flat", False),
    ("binding of 6.1 to the salt gave 8.1 at water", "binding of 7.2 to the salt gave 9.3 at water", True),
    ("the xenone of water and the xenone of salt", "the yrrole of water and the yrrole of salt", True),
    ("the xenone of water and the xenone of salt", "the yrrole of water and the zolide of salt", False),
    ("the xenone of water and the xenone of salt", "the xenone of salt and the xenone of water", False),
    ("5 mg 3 ml xenone 7", "6 mg 4 ml yrrole 8", False),  # no ordinary words: says too little
    ("5 mg 3 ml xenone 7", "5 mg 3 ml xenone 7", True),
]


def test_questions_asked_again(spark):
    """Every pair of the list alone, then all of them at once."""
    for i, (item, doc, want) in enumerate(ASKED_AGAIN):
        got = leaks(spark, [(1, f"zzz {doc} zzz")], [(i, item)], slots="consistent", share=1.0, ordinary=ORDINARY)
        assert got == ({(1, i)} if want else set()), (item, doc)
        assert leakage.windows_match(leakage.words_of(item), leakage.words_of(doc), TEMPLATES, "consistent") == want


def test_planted_variants_precision_and_recall(spark):
    rng = random.Random(12)
    name = lambda: "".join(rng.choice("bcdfgklmnprstvz") + rng.choice("aeiou") for _ in range(4))
    frames = ["heat {0} in {n} mg of water then cool the {1} for {m} h", "the {0} melts at {n} k and the {1} stayed flat with a salt of {0}", "binding of {0} to {1} gave log {n} at {m} k and the {0} melts"]
    fill = lambda f, a, b, n, m: f.format(a, b, n=n, m=m)
    items, docs = [], []
    for i in range(30):
        a, b = name(), name()
        two = [frames[i % 3], frames[(i + 1 + i // 3 % 2) % 3]]
        n, m, k, j = rng.sample(range(10, 99), 4)
        items.append((i, f"{fill(two[0], a, b, n, m)}. {fill(two[1], b, a, k, j)}"))
        c, d = name(), name()
        p, q, r, t = rng.sample(range(100, 999), 4)
        docs.append((100 + i, f"{name()} {fill(two[0], c, d, p, q)}. {fill(two[1], d, c, r, t)} {name()}"))
        docs.append((200 + i, f"{fill(two[0], c, d, p, q)}. {fill(two[1], c, d, r, t)}"))  # names changed places half way
    whole = {(d, i) for d, t in docs for i, u in items if leakage.windows_match(leakage.words_of(t)[1:-1] if d < 200 else leakage.words_of(t), leakage.words_of(u), TEMPLATES, "consistent")}
    got = leaks(spark, docs, items, slots="consistent", share=1.0, ordinary=ORDINARY)
    assert got == whole
    assert {(100 + i, i) for i in range(30)} <= got  # recall
    assert not {x for x in got if x[0] >= 200}  # precision: none of the decoys
    assert leaks(spark, docs, items, share=1.0, ordinary=ORDINARY) == set()


def test_the_template_makes_the_candidates(spark):
    item = "Binding of mextherene to water gave log K 5.96 at 309.0 K and mextherene stayed flat"
    docs = [(1, item.replace("mextherene", "kavalione")), (2, item.replace("mextherene", "ropalide", 1)), (3, item)]
    it = spark.createDataFrame([(7, item)], "item_id bigint, text string")
    for slots, found in (("same", {3}), ("consistent", {1, 3})):
        joined = leakage.leak_candidates(documents(spark, docs), it, slots=slots, share=1.0, ordinary=ORDINARY)
        assert {r.doc for r in joined.collect()} == {1, 2, 3}
        assert {r[0] for r in leaks(spark, docs, [(7, item)], slots=slots, share=1.0, ordinary=ORDINARY)} == found


def test_items_in_several_passes(spark, monkeypatch):
    rng = random.Random(4)
    item = lambda n: " ".join(rng.choice(ORDINARY) for _ in range(n))
    items = [(i, item(rng.randint(1, 20))) for i in range(30)]
    docs = [(d, item(rng.randint(1, 100))) for d in range(40)]
    want = leaks(spark, docs, items, ordinary=ORDINARY)
    monkeypatch.setattr(leakage, "ITEMS_WINDOWS", 60)
    assert leaks(spark, docs, items, ordinary=ORDINARY) == want == brute(docs, items)


def test_an_instance_that_differs_hides_no_later_one(spark):
    item = "Binding of mextherene to water gave log K 5.96 at 309.0 K and mextherene stayed flat"
    other = item.replace("mextherene", "kavalione", 1)
    renamed = item.replace("mextherene", "kavalione").replace("5.96", "8.10")
    docs = [(1, f"{other} {renamed}"), (2, f"{other} {item}"), (3, f"{other} {other}")]
    assert leaks(spark, docs, [(7, item)], slots="consistent", share=1.0, ordinary=ORDINARY) == {(1, 7), (2, 7)}
    # the windows of the item: its second half alone has two equal names
    halves = "the mextherene of kavalione melts the mextherene of mextherene melts"
    assert leaks(spark, [(1, "the ropalide of ropalide melts")], [(7, halves)], slots="consistent", ordinary=ORDINARY) == {(1, 7)}


def test_consistent_leaks_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = "the of mextherene kavalione ropalide 12 980 melts".split()
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items, docs = [(i, text(rng.randint(4, 20))) for i in range(30)], [(d, text(rng.randint(5, 60))) for d in range(40)]
    want = set()
    for i, t in items:
        w = leakage.words_of(t)
        n = leakage.run_length(len(w), 0.5)
        for d, x in docs:
            v = leakage.words_of(x)
            if any(leakage.windows_match(v[a : a + n], w[b : b + n], TEMPLATES, "consistent") for a in range(len(v) - n + 1) for b in range(len(w) - n + 1)):
                want.add((d, i))
    assert leaks(spark, docs, items, slots="consistent", ordinary=ORDINARY) == want
    assert 40 < len(want) < 1200


def test_no_items_or_documents(spark):
    assert leaks(spark, [(1, "a b")], []) == set()
    assert leaks(spark, [], [(1, "a b")]) == set()


# packing


def packed(spark, sizes, **kw):
    df = spark.createDataFrame([(i, s, 5) for i, s in enumerate(sizes)], "doc_id bigint, size bigint, length int")
    return packing.pack(df, "doc_id", F.col("size"), **kw).collect()


def check_packing(rows, sizes, capacity):
    by_doc, by_container = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_container.setdefault(r.container_id, []).append(r)
    assert sorted(by_doc) == list(range(len(sizes)))
    for d, pieces in by_doc.items():
        n = max(0, sizes[d] or 0)
        spans = sorted((p.token_start, p.token_end) for p in pieces)
        assert spans[0][0] == 0
        assert spans[-1][1] == n
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
        assert len(pieces) == max(1, math.ceil(n / capacity))
    for rs in by_container.values():
        rs.sort(key=lambda r: r.position)
        assert [r.position for r in rs] == list(range(1, len(rs) + 1))
        at = 0
        for r in rs:
            n = r.token_end - r.token_start
            assert n == 0 or r.container_offset == at
            at += n
        assert at <= capacity
    return len(by_container)


def test_packing_is_whole_and_tight(spark):
    rng = random.Random(6)
    sizes = [rng.choice([0, None, -3, 64, rng.randint(1, 300), int(rng.lognormvariate(5, 1))]) for _ in range(3000)] + [5000, 2048, 2049, 4096]
    rows = packed(spark, sizes, rows_per_shard=200)
    n = check_packing(rows, sizes, 2048)
    least = math.ceil(sum(max(0, s or 0) for s in sizes) / 2048)
    assert n <= least * 1.02 + 1
    groups = {}
    for r in rows:
        groups.setdefault(r.step_group, set()).add(r.container_id)
    assert max(map(len, groups.values())) <= 8 + 1


def test_one_length_for_all(spark):
    rows = packed(spark, [700] * 1000, rows_per_shard=100)
    assert check_packing(rows, [700] * 1000, 2048) == 500


@pytest.mark.parametrize("sizes", [[], [0, None], [2048], [1], [2049]])
def test_small_inputs(spark, sizes):
    check_packing(packed(spark, sizes), sizes, 2048) if sizes else packed(spark, sizes)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(1, 50), max_size=30))
def test_plan_uses_every_item_once(histogram):
    plan = packing.make_plan(histogram, 100, (100, 50, 25))
    used = {}
    for p in plan:
        assert sum(s * k for s, k in p.lengths) <= 100
        for s, k in p.lengths:
            used[s] = used.get(s, 0) + k * p.n
    assert used == histogram


TEXT_LENGTHS = {s: 1 + 4000 // s for s in (40, 61, 97, 130, 171, 203, 254, 299, 333, 410, 507, 602, 777, 901, 1024, 1100, 1500, 2047)}


def test_tiers_make_the_plan():
    plans = {t: packing.make_plan(TEXT_LENGTHS, 2048, t) for t in [(2048, 1024, 512, 256), (2048,), (2048, 1500, 77, 3)]}
    assert len({str(p) for p in plans.values()}) == 3
    for tiers, plan in plans.items():
        for p in plan:
            for w, _ in p.windows:
                assert w.tier in tiers
                assert w.length <= w.tier
                below = max([t for t in tiers if t < w.tier], default=0)
                assert below < w.items[0][0]  # its longest item was routed to this tier
        total = sum(s * n for s, n in TEXT_LENGTHS.items())
        if all(2048 % t == 0 and t > 100 for t in tiers):  # windows of 1500 leave rests that nothing fills
            assert sum(p.n for p in plan) <= 1.03 * total / 2048 + 1


def test_reports_of_a_packing(spark):
    rng = random.Random(2)
    sizes = [int(rng.lognormvariate(5.3, 0.9)) for _ in range(2000)] + [0, None, 9000]
    df = spark.createDataFrame([(i, s, 5) for i, s in enumerate(sizes)], "doc_id bigint, size bigint, length int")
    packed = packing.pack(df, "doc_id", F.col("size")).cache()
    faults = packing.packing_faults(packed, "doc_id").first().asDict()
    total = sum(s or 0 for s in sizes)
    pieces = sum(max(1, math.ceil((s or 0) / 2048)) for s in sizes)
    assert faults == {"n_items": 2003, "n_pieces": pieces, "n_tokens": total, "needlessly_cut": 0, "gaps": 0, "overfull": 0, "misplaced": 0}
    tiers = {r.tier: r for r in packing.tier_report(packed).collect()}
    assert set(tiers) == {256, 512, 1024, 2048}
    assert sum(r.n_tokens for r in tiers.values()) == total
    assert sum(r.unused for r in tiers.values()) == 2048 * sum(r.n_containers for r in tiers.values()) - total
    assert sum(r.unused for r in tiers.values()) < 0.02 * total
    costs = [r.cost for r in packing.packing_report(packed).collect()]
    # groups of eight containers, some of one fewer
    assert max(costs) <= 8 / 7 * 1.05 * sum(costs) / len(costs)


def test_token_count(spark):
    df = spark.createDataFrame([("a b-c, dé", None), ("a", 7), (None, 9), ("", 3), ("x  .. y", -1)], "t string, n bigint")
    assert [r[0] for r in df.select(packing.token_count(F.col("t"), F.col("n"))).collect()] == [7, 7, 0, 0, 3]
