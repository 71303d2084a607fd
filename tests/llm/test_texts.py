import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessela.llm import leakage, mixing
from tessela.llm import text_quality as tq

WORDS = "amber basket cellar dragon engine forest garden harbour island jungle kettle ladder marble needle orange pepper quarry ribbon saddle timber urchin velvet walnut yellow zephyr".split()


def sentence(seed, n):
    return " ".join(random.Random(seed).choices(WORDS, k=n))


PASSAGE, QUESTION = sentence(1, 40), sentence(2, 15)


def leaks(spark, docs, items, **more):
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id int")
    q = spark.createDataFrame([(*i, "say so") for i in items], "item_id long, passage string, question string, prompt string")
    return {tuple(r) for r in leakage.leaks(d, q, **more).collect()}


def test_leaks(spark):
    p, w = PASSAGE.split(), QUESTION.split()
    part = " ".join(x for i in range(0, 40, 7) for x in [*p[i : i + 6], "stranger"])
    docs = [
        (1, f"before {' '.join(p[3:15])} after"), (2, f"before {' '.join(p[3:14])} after"), (3, "<b>" + "</b>,\n<i>".join(p[5:20]).upper()), (4, part), (5, " ".join(x for i in range(0, 40, 6) for x in [*p[i : i + 5], "stranger"])),
        (6, "… ".join(w[1:14])), (7, " ".join(w[:11])), (8, None), (9, "   "), (10, "say so " * 30), (11, PASSAGE * 3 + "x" * 5000), (12, " ".join(p[:12]).replace("a", "á").replace("e", "ｅ")), (13, "un" + "".join(p[:12])),
    ]
    items = [(100, PASSAGE, None), (101, PASSAGE, QUESTION), (102, None, QUESTION), (103, "", ""), (None, PASSAGE, None)]
    both = {(d, i) for d in (1, 3, 4, 11, 12) for i in (100, 101)} | {(6, 101), (6, 102)}
    assert leaks(spark, docs, items) == both
    assert leaks(spark, docs, items, block=1) == both
    assert leaks(spark, docs, []) == set() and leaks(spark, [], items) == set()


def expected_leaks(doc, targets, run=12, part=6):
    out = set()
    for no, target in enumerate(targets):
        covered = set()
        for i in range(len(doc)):
            for j in range(len(target)):
                if (i == 0 or j == 0 or doc[i - 1] != target[j - 1]) and doc[i] == target[j]:
                    n = 0
                    while i + n < len(doc) and j + n < len(target) and doc[i + n] == target[j + n]:
                        n += 1
                    if n >= run:
                        out.add(no)
                    if n >= part and no == 0:
                        covered |= set(range(j, j + n))
        if covered and len(covered) >= 0.5 * len(target):
            out.add(no)
    return out


def made_up(rng):
    source, cut = rng.choice([(PASSAGE, 40), (QUESTION, 15)])
    words = source.split()
    a = rng.randrange(cut)
    text = words[a : a + rng.randint(3, 25)]
    for _ in range(rng.randint(0, 3)):
        text.insert(rng.randrange(len(text) + 1), rng.choice(["other", "xylem", *WORDS]))
    return ["lorem", *text, "ipsum"]


def test_leaks_equal_a_word_by_word_search(spark):
    rng = random.Random(4)
    docs = [made_up(rng) for _ in range(300)]
    targets = (PASSAGE.split(), QUESTION.split())
    for doc in docs:
        got = set()
        for no, target in enumerate(targets):
            run, covered = leakage.aligned(leakage.Side(doc), leakage.Side(target), 12, 6)
            if run or no == 0 and covered and len(covered) >= 0.5 * len(target):
                got.add(no)
        assert got == expected_leaks(doc, targets)
    joined = [sum(docs[i : i + 5], []) for i in range(0, 300, 5)]
    expected = {(i, no) for i, doc in enumerate(joined) for no in expected_leaks(doc, targets)}
    assert leaks(spark, [(i, " ".join(d)) for i, d in enumerate(joined)], [(0, PASSAGE, None), (1, None, QUESTION)]) == expected


def test_edit_budget(spark):
    words = PASSAGE.split()[:14]
    slipped = [*words[:6], words[6][:2] + "q" + words[6][3:], *words[7:]]
    lost = [*words[:6], words[6][:2] + words[6][3:], *words[7:]]
    for doc in (slipped, lost):
        sides = leakage.Side(doc), leakage.Side(PASSAGE.split())
        assert not leakage.aligned(*sides, 12, 6)[0] and leakage.aligned(*sides, 12, 6, edits=1)[0]
        assert leakage.promising(*sides, 40, 1) and not leakage.promising(*sides, 400, 1)
    docs = [(1, " ".join(slipped)), (2, " ".join(lost)), (3, " ".join(words[:11]))]
    assert leaks(spark, docs, [(9, PASSAGE, None)]) == set()
    assert leaks(spark, docs, [(9, PASSAGE, None)], edits=1) == {(1, 9), (2, 9)}


def test_many_items_without_passages(spark):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 8))) for _ in range(3000)]
    questions = [" ".join(rng.choices(vocabulary, k=14)) for _ in range(2000)]
    shared = " ".join(vocabulary[:13])
    items = [(i, None if i % 2 else " ".join(rng.choices(vocabulary, k=30)), q) for i, q in enumerate(questions)] + [(5000 + i, None, f"{shared} {w}") for i, w in enumerate(vocabulary[20:320])]
    docs = [(i, f"start {questions[i * 7]} end") for i in range(50)] + [(100, shared), (101, shared), (102, " ".join(vocabulary[:11]))]
    expected = {(i, i * 7) for i in range(50)} | {(d, 5000 + i) for d in (100, 101) for i in range(300)}
    assert leaks(spark, docs, items, block=64) == expected


def test_long_regions_are_cut_without_losing_stretches():
    sieve = np.full(1 << 13, 255, np.uint8)
    text = [w for i in range(60) for w in sentence(100 + i, 20).split()]
    got = leakage.regions([["a"], text, []], sieve, 16, 20, 20, 300)
    assert {d for d, _ in got} == {1} and len(got) > 1
    for i in range(0, len(text) - 14):
        assert any(" ".join(text[i : i + 14]) in " ".join(w) for _, w in got)
    assert leakage.regions([["a"], []], sieve, 16, 20, 20, 300) == [] and leakage.regions([text], np.zeros(1 << 13, np.uint8), 16, 20, 20, 300) == []


def share_of_prose(text):
    return tq.ratios(np.array(tq.count_texts([text])))[7][0]


def kinds(text):
    out = []
    for line in text.split("\n"):
        sums = tq.count_texts([line])[0]
        out.append(tq.KINDS[int(sums[:, 0].argmax())])
    return out


PROSE = "We bought this lamp for my brother and it has worked well for the whole winter. The light is warm, and the switch feels solid."


@pytest.mark.parametrize(
    "text",
    [PROSE, PROSE.upper(), PROSE.lower().replace(".", ""), PROSE.replace(" ", "\n", 3), "— " + PROSE, "Wir haben das Gerät in der Küche benutzt, und der Deckel ist immer noch stabil.", "El visor es firme y el color es igual que en la foto.", "C'est un cadeau pour ma sœur, qui trouve le casque assez mince.", "> " + PROSE],
)
def test_prose(text):
    assert share_of_prose(text) > 0.5


@pytest.mark.parametrize(
    "text",
    ["- red lamp\n- blue lamp\n* the black lens of a garden", "1. garden cable, 3 pcs\n2) lamp cover, 4 pcs", "| a | b |\n|---|---|\n| lamp | 3 |", "Motor: 45 g\nLens = 66 navy", "a,b,c,4,5.5\nd,e,f,6,7.5", "Home > Shop > Lamps | Blue\nSign in | Cart", "#lamp #blue #garden #night", '<div class="x"><span>blue</span></div>', '{"sku": 9, "lamp": "blue", "tags": ["a"]}', "2023-09-05 08:32:07 INFO worker-32 rc=3", "ha ha ha ha ha ha", "wgcqb rqjncjdsz epyklpkqqx xcccwembzs iqkazgky", "Ã¾œ¿Ð™€ ¤¢¿ÐÑ¾™ œ¿¤¢€ Â¿™¾", "SGVsbG8gd29ybGQgdGhpcyBpcyBiYXNlNjQgZW5jb2RlZCB0ZXh0", "Lamp for the boss    89 of 98\nSum of the lamps    45.10", "sharp, stiff, bright, blue, solid, warm, red, lamp"],
)
def test_no_prose(text):
    assert share_of_prose(text) < 0.5


TEXTS = st.lists(
    st.sampled_from(["the lamp is on.", "- red", "\n", "\n\n", " ", "    ", "a,b,c", "\tx", "word" * 9, "ha ha ha ", "|", "<b>x</b>", "é¿¤", "12.5", "x" * 1000, "the " * 3, "y" * 300 + ",", "#tag", "\n" + " " * 500, "…" * 70, "«q»", "z" * 64, "z" * 65]), max_size=40
).map("".join)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_cuts_change_nothing(text):
    whole = tq.count_texts([text], piece=1 << 30)[0]
    for size, reach in ((1, 64), (7, 64), (7, 200), (300, 64), (200_000, 256)):
        assert (tq.count_texts([text], size, reach)[0] == whole).all()


@settings(max_examples=100, deadline=None)
@given(TEXTS, st.data())
def test_parts_add_up_in_any_order(text, data):
    pieces = [(t, False, a, b) for t, _, a, b in tq.cut_pieces(text, 5, 64)]
    parts = tq.count(pieces)[1]
    while len(parts) > 1:
        i = data.draw(st.integers(0, len(parts) - 2))
        parts[i : i + 2] = [tq.Part.load((parts[i] + parts[i + 1]).dump())]
    assert (parts[0].finish() == tq.count_texts([text], 1 << 30)[0]).all()


def test_counts_of_a_line():
    sums = np.array(tq.count_texts(["The old lamp, the OLD lamp   is on (really) #blue x_1 don't.\n\nqq"]))
    stats = {k: v[0] for k, v in zip(("n_chars", "n_lines", "n_words", *tq._RATIOS), tq.ratios(sums))}
    assert stats["n_chars"] == 49 and stats["n_lines"] == 2 and stats["n_words"] == 13
    assert stats["mean_word_length"] == sum(map(len, "The old lamp the OLD lamp is on really blue x_1 don't qq".split())) / 13
    assert stats["common_share"] == 4 / 13 and stats["terminal_share"] == 0.5


def test_quality_of_tables(spark):
    long = (PROSE + "\n") * 300 + "- red lamp\n" * 20
    rows = [(1, PROSE, 5), (2, None, 5), (3, " \n ", 5), (4, "- a\n- b", 5), (None, PROSE, 5), (5, long, 5), (5, long, 5), (6, long.replace("\n", " "), 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars int")
    whole = {r["doc_id"]: r for r in tq.quality(df).collect()}
    assert set(whole) == {1, 4, 5, 6} and [d for d, r in whole.items() if r["not_prose"]] == [4]
    assert whole[1]["n_chars"] == len(re.sub(r"\s", "", PROSE)) and whole[1]["n_words"] == len(PROSE.split())
    for piece, spread in ((1000, 1 << 20), (100, 700), (7, 100)):
        cut = {r["doc_id"]: r for r in tq.quality(df, piece=piece, spread=spread, reach=64).collect()}
        assert cut == whole
    assert tq.quality(df, spread=700).count() == len(whole) and tq.quality(df.where("doc_id > 99")).count() == 0


TARGETS = "source string, target_share decimal(5,2), max_repeats int"


def test_mixing(spark):
    from decimal import Decimal

    rng = random.Random(2)
    topic = {"a": WORDS[:12], "b": WORDS[12:]}
    rows = [(i, s, " ".join(rng.choices(topic[s], k=30)), 1.0) for i, s in enumerate("a" * 60 + "b" * 20)]
    rows += [(100, None, " ".join(topic["a"]), 1.0), (101, "scrape", " ".join(topic["b"]), 1.0), (102, "a", None, 1.0), (None, "a", "x", 1.0), (103, None, None, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, rate double")
    goals = spark.createDataFrame([("a", Decimal("0.40"), 1), ("b", Decimal("0.50"), 3), ("c", Decimal("0.10"), 5)], TARGETS)
    report, plan = mixing.mix(docs, goals)
    got = {r["source"]: r for r in report.collect()}
    assert [s for s, r in got.items() if r["short"]] == ["c"] and got["c"]["own_tokens"] == 0
    for s in "ab":
        assert got[s]["mixed_tokens"] == pytest.approx(got[s]["wanted_tokens"], rel=0.02)
    copies = {r["doc_id"]: r for r in plan.collect()}
    assert set(copies) == {r[0] for r in rows} - {None}
    assert all(r["rate"] <= 1 and r["copies"] <= 1 for r in copies.values() if r["source"] == "a") and max(r["copies"] for r in copies.values()) <= 3
    assert copies[102]["tokens"] == 0
    assert mixing.mix(docs.where("doc_id < 0"), goals)[0].where("own_tokens > 0").count() == 0
    assert mixing.mix(docs, goals.where("source = 'zz'"))[0].count() == 0


def test_predictions_are_right_on_held_out_texts(spark):
    rng = random.Random(3)
    topic = {"a": WORDS[:14], "b": WORDS[10:]}
    made = [(i, " ".join(rng.choices(topic[s], k=25)), s) for i, s in enumerate("ab" * 100)]
    labelled = spark.createDataFrame(made[:150], "doc_id long, text string, source string")
    held = spark.createDataFrame([(m[0], 7, m[1]) for m in made[150:]], "doc_id long, key long, text string")
    told = {r["doc_id"]: r["m0"] for r in mixing.predict_sources(labelled, held, ["a", "b", "c"]).collect()}
    assert sum((told[i] > 0.5) == (s == "a") for i, _, s in made[150:]) >= 45


def test_rates_stay_in_their_bounds(spark):
    members = spark.createDataFrame([(100, 2.0, 1.0, 1.0, 0.0), (50, 3.0, 1.0, 0.0, 1.0), (40, 2.5, 1.0, 0.5, 0.5)], "tokens long, cap double, start double, m0 double, m1 double")
    fit = mixing.fit_rates(members, [150.0, 400.0])
    rows = fit.rated.collect()
    assert all(0 <= r["rate"] <= r["cap"] for r in rows) and fit.totals[0] == pytest.approx(150, rel=0.02) and fit.totals[1] == pytest.approx(200, rel=0.02)
    assert fit.converged and fit.residual == pytest.approx(200 / 550, rel=0.02)
    assert not mixing.fit_rates(members, [150.0, 400.0], steps=1).converged
    assert mixing.fit_rates(members.where("tokens < 0"), [1.0, 1.0]).totals == [0.0, 0.0]


def test_the_fit_decides_what_is_short(spark, monkeypatch):
    from decimal import Decimal

    # Foreign texts could help b out; they don't count for what its own documents reach.
    rows = [(i, "a", " ".join(WORDS[:12])) for i in range(60)] + [(i, "b", " ".join(WORDS[12:])) for i in range(60, 66)] + [(i, "web", " ".join(WORDS[12:])) for i in range(70, 170)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    goals = spark.createDataFrame([("a", Decimal("0.50"), 1), ("b", Decimal("0.50"), 3)], TARGETS)
    got = {r["source"]: r for r in mixing.mix(docs, goals)[0].collect()}
    assert [s for s in "ab" if got[s]["short"]] == ["b"] and got["b"]["expected_share"] > 0.45 and got["b"]["converged"]
    real = mixing.fit_rates
    monkeypatch.setattr(mixing, "fit_rates", lambda members, targets, *more: real(members.withColumn("cap", mixing.F.col("cap") * 2), targets, *more))
    assert not any(r["short"] for r in mixing.mix(docs.where("source != 'web'"), goals)[0].collect())


def test_report_gives_the_shares_of_the_copies_drawn(spark):
    from decimal import Decimal

    rows = [(1, "a", " ".join(WORDS * 40))] + [(i, "b", " ".join(WORDS[:12])) for i in range(2, 82)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    report, plan = mixing.mix(docs, spark.createDataFrame([("a", Decimal("0.25"), 1), ("b", Decimal("0.75"), 3)], TARGETS))
    got, drawn = {r["source"]: r for r in report.collect()}, plan.collect()
    tokens = {s: sum(r["copies"] * r["tokens"] for r in drawn if r["source"] == s) for s in "ab"}
    for s in "ab":
        assert got[s]["actual_tokens"] == tokens[s] and got[s]["actual_share"] == pytest.approx(tokens[s] / sum(tokens.values()))
        assert got[s]["expected_share"] == pytest.approx(got[s]["target_share"], abs=0.01)
    assert abs(got["a"]["actual_share"] - got["a"]["expected_share"]) > 0.1


@pytest.mark.parametrize(
    "text",
    ["Вчера мы ездили на море, и дети весь день играли на песке.\nВечером пошёл дождь, но никто не хотел домой", "Χθες πήγαμε στη θάλασσα και τα παιδιά έπαιζαν όλη μέρα στην άμμο. Το βράδυ έβρεξε πολύ.", "ذهبنا أمس إلى البحر ولعب الأطفال طوال اليوم على الرمال.", "हम कल समुद्र के किनारे गए और बच्चे पूरे दिन रेत पर खेले।"],
)
def test_prose_of_other_scripts(text):
    assert kinds(text) == ["prose"] * len(text.split("\n"))


@pytest.mark.parametrize("text", ["красный, синий, зелёный, белый, чёрный, жёлтый", "- хлеб\n- молоко", "xkjq wvbn zzrt qpfg hjkl mnbv"])
def test_lists_of_other_scripts_and_junk_stay_no_prose(text):
    assert "prose" not in kinds(text)
