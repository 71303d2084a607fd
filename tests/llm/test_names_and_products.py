import itertools

import pytest

from tessela.llm import name_variants as nv
from tessela.llm import product_matching as pm


@pytest.mark.parametrize(
    ("a", "b"),
    [("Dr. José  Vutmeonen*", "VUTMEONEN, Jose"), ("Søren Paskpoić", "Soeren Paskpoić"), ("Mei O. Brultgriaro", "Brultgriaro MO".replace("MO", "Mei O.")), ("Björn Naklewski - Brormdrioglu", "björn naklewski-brormdrioglu"), ("Edward Drutpaova¹", "Edward\xa0Drutpaova, PhD"), ("The Droltruová Univ. of Data Engineering", "Data Engineering University, Droltruová")],
)
def test_one_form(a, b):
    assert nv.parse(a)[:4] == nv.parse(b)[:4]


@pytest.mark.parametrize("name", [None, "", "  ", "et al.", "et al", "ET AL", "*", "Madonna"])
def test_no_names(name):
    assert nv.parse(name) is None


@pytest.mark.parametrize(("a", "b", "expected"), [("smith", "smiht", True), ("smith", "smth", True), ("smith", "smyth", True), ("smith", "smithe", True), ("smith", "smtih", True), ("smith", "stihm", False), ("", "ab", False)])
def test_near(a, b, expected):
    assert nv.near(a, b) is expected


def linked(spark, names):
    df = spark.createDataFrame([(i, [n], "x") for i, n in enumerate(names)], "id int, authors array<string>, name string")
    out = {}
    for r in nv.link_names(df, "id", "authors").collect():
        out.setdefault(r["entity"], set()).add(r["name"])
    return sorted(out.values(), key=sorted)


def test_people_and_institutions(spark):
    one = ["Giuseppe Grotrekar", "Grotrekar, G.", "Beppe Grotrekar", "Giuseppe Grotrekra", "GROTREKAR, Giuseppe", "Giuseppe Anton Grotrekar", "Guiseppe Grotrekar"]
    two = ["Anna Grotrekar", "Grotrekar, Anna", "A Grotrekar"]
    three = ["Kukziell Department of Machine Perception", "Kukziell Dept. Mach. Perc.", "Department of Machine Perception, Kukziell", "Kukziell Department of Machine Percpetion"]
    four = ["Kukziell Laboratory of Machine Perception", "Kukziell Lab of Machine Perception"]
    rows = one + ["Giuseppe Grotrekar"] * 3 + two + ["Anna Grotrekar"] * 2 + three + four + ["et al.", "", None]
    assert linked(spark, rows) == sorted([set(one), set(two), set(three), set(four)], key=sorted)


def test_repeats_of_one_slip_establish_no_name(spark):
    surnames = [f"{a}{b}" for a in ("Brunt", "Dlosk", "Frimb", "Gleph", "Krazd", "Tworm") for b in ("owiak", "itzer", "ulescu", "agnini", "endahl")]
    right, slips = [f"Victoria {s}" for s in surnames], [f"Victoira {s}" for s in surnames[:6]]
    own = [f"Viktoria {s}" for s in surnames]
    family, wrong = [f"{f} Grotrekar" for f in ("Anna", "Boris", "Clara", "Victoria")], ["Anna Grotrekra", "Boris Grotrekra", "Clara Grotrekra"]
    rows = right * 20 + slips * 2 + own * 10 + family * 100 + wrong * 2
    expected = [{r, r.replace("Victoria", "Victoira")} if i < 6 else {r} for i, r in enumerate(right)] + [{o} for o in own]
    expected += [{f, w} for f, w in zip(family, wrong)] + [{family[3]}]
    assert linked(spark, rows) == sorted(expected, key=sorted)


def test_a_name_may_be_its_own(spark):
    rows = ["Karl Hansen"] * 50 + ["Karl Hanson"] * 49 + ["Anna Grotrekar"] * 50 + ["Anna Grotrejar"] * 20 + ["Anna Grotrekra"] * 2 + ["Boris Flumdeik"] * 50 + ["Boris Flumdoik"]
    assert linked(spark, rows) == sorted([{"Karl Hansen"}, {"Karl Hanson"}, {"Anna Grotrekar", "Anna Grotrejar", "Anna Grotrekra"}, {"Boris Flumdeik", "Boris Flumdoik"}], key=sorted)


def test_nicknames_are_learnt_from_surnames(spark):
    surnames = [f"{a}{b}" for a in ("Brunt", "Dlosk", "Frimb", "Gleph", "Krazd", "Tworm") for b in ("owiak", "itzer", "ulescu")]
    rows = [f"Zebulon {s}" for s in surnames] * 3 + [f"Zuzu {s}" for s in surnames[:8]] + [f"Miriam {s}" for s in surnames[:2]] + ["Zuzu Grotrekar", "Miriam Grotrekar"]
    expected = [{f"Zebulon {s}", f"Zuzu {s}"} if i < 8 else {f"Zebulon {s}"} for i, s in enumerate(surnames)] + [{f"Miriam {s}"} for s in surnames[:2]] + [{"Zuzu Grotrekar"}, {"Miriam Grotrekar"}]
    assert linked(spark, rows) == sorted(expected, key=sorted)


@pytest.mark.parametrize(("a", "b", "kind"), [("smith", "smith", 0), ("smith", "smiht", 1), ("smith", "smth", 1), ("smith", "smitth", 1), ("smith", "smirh", 1), ("smith", "smath", 2), ("smith", "stihm", None), ("a", "b", 2), ("", "", 0), ("", "b", 1), ("ab", "ba", 1)])
def test_kinds_of_change(spark, a, b, kind):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(nv._change(nv.F.col("a"), nv.F.col("b"))).first()[0] == kind
    assert (kind is not None) is nv.near(a, b)


def test_split_keys_change_nothing(spark):
    firsts = ["Anna", "Anne", "Annika", "Arno", "Axel", "Adam", "Alina", "Alfred"]
    rows = [f"{f} Grotrekar" for f in firsts] * 3 + ["A Grotrekar", "A. B. Grotrekar", "Anna B. Grotrekar", "Grotrekar, Axle"]
    df = spark.createDataFrame([(i, [n]) for i, n in enumerate(rows)], "id int, authors array<string>")
    one, two = ({(r["name"], r["entity"]) for r in nv.link_names(df, "id", "authors", block).collect()} for block in (512, 2))
    assert one == two


def test_pairs_order_and_empty(spark):
    df = spark.createDataFrame([(1, ["Anna Grotrekar", "anna grotrekar", None]), (1, ["Anna Grotrekar", "anna grotrekar", None]), (2, None), (3, [])], "id int, authors array<string>")
    assert [tuple(r) for r in nv.variant_pairs(df, "id", "authors").collect()] == [("Anna Grotrekar", "anna grotrekar")]
    assert nv.variant_pairs(df.where("id > 9"), "id", "authors").count() == 0


@pytest.mark.parametrize(("digits", "ok"), [("4006381333931", True), ("4006381333932", False), ("036000291452", True), ("96385074", True), ("00000000", False), ("123", False)])
def test_check_digits(digits, ok):
    assert (pm.trade_number(digits) is not None) is ok


def test_properties_have_common_units():
    same = ['15.6 inch, 1 TB, 2,500 grams, BLK', '15.6" / 1000GB / 2.5kg / jet black', "39.6 cm 1 terabyte 2500 g noir"]
    assert len({tuple(sorted(pm.properties(x).items())) for x in same}) == 1
    assert pm.properties("1,200 W 1.7 L 48hrs 150 cm") == {"power": "1200", "volume": "1700", "time": "2880", "length": "1500"}
    assert "memory" not in pm.properties("64 GB or 128 GB")


def listing(i, name, about="", brand="Hexmar", weight=None, at=1):
    return (i, name, about, brand, weight, at, "x", 1)


SCHEMA = "product_id int, name string, description string, brand string, weight_kg decimal(8,2), last_updated int, family string, no int"


def groups(spark, rows):
    from decimal import Decimal

    df = spark.createDataFrame([(*r[:4], Decimal(r[4]) if r[4] else None, *r[5:]) for r in rows], SCHEMA)
    pairs = {tuple(r) for r in pm.same_product_pairs(df).collect()}
    assert all(a < b for a, b in pairs)
    return pairs


def test_listings(spark):
    same = [listing(1, "Hexmar Skolklu Ember desk lamp YE-1801 Pro, 65 W, blue", weight="1.20"), listing(2, "SALE YE1801 Pro lamp by hexmar", "ocean blue, 65 watts", "Hexmar Inc.", "1.20"), listing(3, "Hexmar Skolklu Ember Pro lamp 65W BLU", weight="1.20"), listing(4, "YE 1801-Pro Skolklu lamp", "65 W and blue from Hexmar", None)]
    other = [listing(5, "Hexmar YE-1801 lamp, 65 W, blue"), listing(6, "Hexmar YE-1801 Pro lamp, 65 W, red"), listing(7, "Sleeve for Hexmar YE-1801 Pro lamp, 65 W, blue"), listing(8, "Twin pack: Hexmar YE-1801 Pro lamp, 65 W, blue"), listing(9, "Ostrel YE-1801 Pro lamp, 65 W, blue", brand="Ostrel"), listing(10, "", None, None), listing(11, None, None, None)]
    more = [listing(20 + i, "Hexmar Skolklu YE-1801 Plus lamp green 20 W", brand="Hexmar") for i in range(3)]
    resent = [listing(1, "old text", at=0)]
    assert groups(spark, same + other + more + resent) == set(itertools.combinations([1, 2, 3, 4], 2)) | set(itertools.combinations([20, 21, 22], 2))
    assert groups(spark, []) == set()


def test_maker_slips_and_trade_numbers(spark):
    rows = [listing(i, f"Hexmar ZK-{100 + i} lamp") for i in range(12)] + [listing(50, "Hexmra ZK-105 lamp", brand="Hexmra")]
    rows += [listing(60, "Thing", "EAN 4006381333931", None), listing(61, "Another text", "4006381333931", None), listing(62, "Third", "4006381333932", None)]
    assert groups(spark, rows) == {(5, 50), (60, 61)}


def test_guard_splits_equal_weights():
    out, sums = pm.join_alike(["colour=red;power=20", "colour=blue;power=20", "colour=red"])
    assert out[0] == out[2] != out[1] and sorted(sums) == ["colour=blue;power=20", "colour=red;power=20"]
    known = [("colour=red;power=20", 1), ("colour=blue;power=20", 1), ("colour=pink", 2)]
    got = pm.attach(known, ["colour=red", "power=20", "colour=green", "", "colour=pink", "colour=green;power=20", "power=20;time=5"])
    assert got[0] == 0 and got[2] == got[5] >= 3
    assert len({got[1], got[3], got[4], got[6], 0, 1, 2}) == 7


def test_trade_numbers_join_across_families(spark):
    first, second = "4006381333931", "036000291452"
    rows = [listing(1, "Acme TR200 Kettle 1.5 l", first, "Acme"), listing(2, "Steel kettle", first, None), listing(3, "Acne TR-201 kettle", f"{first} {second}", "Acne"), listing(4, "Kettle", second, ""), listing(5, "Another kettle", None, None)]
    assert groups(spark, rows) == set(itertools.combinations([1, 2, 3, 4], 2))
    assert groups(spark, rows[:2]) == {(1, 2)}


def test_contradictions_cut_the_weakest_edges(spark):
    number = "4006381333931"
    strong = [listing(i, "Acme TR200 kettle 1.5 l", number, "Acme") for i in range(5)] + [listing(i, "Kettle 1.5 l", number, None) for i in (5, 6)]
    wrong = [listing(7, "Bolt QX300 lamp 40 W, 2 l", number, "Bolt"), listing(8, "Bolt QX300 lamp 40 W, 2 l", None, "Bolt")]
    assert groups(spark, strong) == set(itertools.combinations(range(7), 2))
    got = groups(spark, strong + wrong)
    assert (7, 8) in got and not any(a < 7 <= b for a, b in got) and set(itertools.combinations(range(5), 2)) <= got


def test_a_hot_family(spark):
    rows = [listing(i, "Acme TR200 kettle", f"{i % 3 + 1} l, {'red' if i % 2 else 'blue'}", "Acme", f"{i % 500 + 1}.00") for i in range(3000)]
    rows += [listing(10_000, "Acme TR200 kettle", "1 l", "Acme"), listing(10_001, "Acme TR200 kettle", "7 l", "Acme"), listing(10_002, "Acme TR200 kettle", "7 l, red", "Acme")]
    from decimal import Decimal

    df = spark.createDataFrame([(*r[:4], Decimal(r[4]) if r[4] else None, *r[5:]) for r in rows], SCHEMA)
    got = {r["product_id"]: r["group_id"] for r in pm.group_listings(df).collect()}
    assert len(set(got.values())) == 1500 + 2 and got[0] == got[1500] and got[10_001] == got[10_002] and list(got.values()).count(got[10_000]) == 1
