"""Variant spellings of the names of people and institutions, attributed by a noisy channel.

Strings that differ only in case, accents, titles, footnote marks, spacing, comma order or joined initials are one form. Forms
are then attributed: a frequent full form is a candidate for the forms that reach it by an abbreviation, a nickname, a dropped part or a typing
slip. A form joins the candidate with the greatest posterior, the prior being the candidate's frequency. One that could only be a slip is
also its own candidate, with a prior of its own: it stays by itself where no slip is that likely. Nicknames come from a
list of common ones and from the names themselves. A slip needs a
token that isn't established by itself: a first name seen with several surnames, or a surname seen with several first
names, is a name of its own, unless slips of a far more frequent neighbour explain how often it is seen.

Slips of the hand (a neighbouring key, two letters swapped, one doubled or left out) are told from other changed letters, which are rather
other names. How likely each change is comes from the attributions themselves: they are made with first values, counted, and made again.

Candidates meet over keys (surname and first name, each with single characters left out), frequent keys in blocks; a form is compared with
those that share a key only, by built-in functions.
"""

from __future__ import annotations

import math
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessela.llm.cooccurrence import basket_pairs
from tessela.runtime import checkpoint, written

# Short forms of first names, as used by people, with the full forms they stand for.
NICKNAMES = {
    "abby": "abigail", "alex": "alexander alexandra", "sasha": "alexander alexandra", "andy": "andrew", "tony": "anthony", "toni": "antonia anton", "ben": "benjamin", "beppe": "giuseppe", "peppe": "giuseppe",
    "bill": "william", "will": "william", "billy": "william", "bob": "robert", "rob": "robert", "bobby": "robert", "cathy": "catherine katherine", "kate": "katherine catherine", "katie": "katherine", "kathy": "katherine",
    "charlie": "charles", "chuck": "charles", "chris": "christopher christine", "cindy": "cynthia", "dan": "daniel", "danny": "daniel", "dave": "david", "debbie": "deborah", "dima": "dmitri", "mitya": "dmitri",
    "dick": "richard", "rick": "richard", "rich": "richard", "dot": "dorothy", "dottie": "dorothy", "dolly": "dorothy", "lola": "dolores", "lolita": "dolores", "ed": "edward", "eddie": "edward", "ted": "edward", "ned": "edward",
    "theo": "theodore", "liz": "elizabeth", "beth": "elizabeth", "betty": "elizabeth", "lizzie": "elizabeth", "lisa": "elisabeth", "fred": "frederick friedrich", "freddy": "frederick", "greg": "gregory", "gosia": "malgorzata", "hannes": "johannes", "hans": "johannes",
    "jim": "james", "jimmy": "james", "jamie": "james", "jen": "jennifer", "jenny": "jennifer", "joe": "joseph", "joey": "joseph", "pepe": "jose", "josh": "joshua", "kasia": "katarzyna", "katya": "ekaterina", "katja": "ekaterina", "larry": "lawrence", "maggie": "margaret",
    "meg": "margaret", "peggy": "margaret", "matt": "matthew", "mick": "michael", "mike": "michael", "mickey": "michael", "misha": "mikhail", "nick": "nicholas", "kolya": "nikolai", "paco": "francisco", "pancho": "francisco", "pat": "patricia patrick", "patty": "patricia", "pete": "peter",
    "phil": "philip", "sam": "samantha samuel", "sammy": "samantha", "steve": "stephen steven", "sue": "susan", "susie": "susan", "suzy": "susan", "tanya": "tatiana", "tania": "tatiana", "tom": "thomas", "tommy": "thomas", "vicky": "victoria", "vicki": "victoria", "tori": "victoria", "vitya": "viktor",
    "volodya": "vladimir", "vova": "vladimir", "wanda": "wandalina", "zuzia": "zuzanna", "aga": "agnieszka", "agus": "agnieszka", "olya": "olga", "lena": "helena", "nacho": "ignacio", "chema": "jose", "kurt": "konrad", "uli": "ulrich", "ula": "ursula", "uschi": "ursula", "fritz": "friedrich", "bia": "beatriz", "becky": "rebecca", "stevie": "stephen", "heinz": "heinrich",
    "gigi": "luigi", "sandro": "alessandro", "mimmo": "domenico", "nino": "antonino", "gianni": "giovanni", "nat": "nathaniel", "ken": "kenneth", "ron": "ronald", "don": "donald", "tim": "timothy", "jeff": "jeffrey", "gabe": "gabriel", "bea": "beatriz", "cris": "cristina", "fer": "fernando", "rafa": "rafael", "bruninho": "bruno",
}
# Kinds of institutions with the beginnings that stand for them.
KINDS = {
    "university": ("university", "univ", "universitat", "universite", "universidad", "uni"), "institute": ("institute", "inst", "institut", "instituto"),
    "department": ("department", "dept", "dep", "departement", "dpt"), "centre": ("centre", "center", "cent", "ctr", "centro"), "laboratory": ("laboratory", "lab", "labs", "laboratories", "labor"),
    "consortium": ("consortium", "cons", "consort"), "school": ("school", "sch"), "faculty": ("faculty", "fac"), "college": ("college", "coll"), "academy": ("academy", "acad"),
    "hospital": ("hospital", "hosp"), "foundation": ("foundation", "found"), "society": ("society", "soc"), "council": ("council",), "agency": ("agency",), "group": ("group", "grp"),
}
_KIND_OF = {short: kind for kind, shorts in KINDS.items() for short in shorts}
_SMALL = frozenset("of for the and in de la du der des für fur di et an &".split())
_TITLE = re.compile(r"^(?:(?:dr|prof|professor|mr|mrs|ms|sir|dipl|ing|priv|doz)\b\.?[ -]*)+", re.I)
_DEGREE = re.compile(r"[,\s]+(?:ph\.?\s?d|m\.?\s?sc|b\.?\s?sc|m\.?d|msc|esq|jr|sr|ii|iii|iv)\.?$", re.I)
_MARK = re.compile(r"[*†‡§¶#^⁰¹²³⁴⁵⁶⁷⁸⁹₀-₉]|\[\d+\]|\(\d+\)|(?<=[^\W\d_])\d+(?:,\d+)*$")
_ET_AL = re.compile(r"^\W*et\W*al\W*$|^\W*(?:and\W+)?others\W*$", re.I)
_FOLD = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ı": "i", "æ": "a", "œ": "o", "ß": "ss", "þ": "th", "ð": "d"})


def fold(text: str) -> str:
    plain = unicodedata.normalize("NFKD", text.casefold()).translate(_FOLD)
    return "".join(c for c in plain if not unicodedata.combining(c))


def key(word: str) -> str:
    """A folded word with oe, ae, ue as their umlauts' bare vowels, and without hyphens and apostrophes."""
    bare = re.sub(r"[^a-z]", "", word)
    return re.sub(r"([oau])e", r"\1", bare) if len(bare) >= 6 else bare


_FULL = {key(short): frozenset(map(key, full.split())) for short, full in NICKNAMES.items()}


def _full(first: str) -> frozenset[str]:
    return _FULL.get(first, frozenset()) | {first}


def near(a: str, b: str) -> bool:
    """At most one insertion, deletion, substitution or swap of neighbours apart."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i:] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])


def _kind(word: str) -> str | None:
    bare = word.rstrip(".")
    if bare in _KIND_OF:
        return _KIND_OF[bare]
    if len(bare) >= 6:
        return next((k for k in KINDS if near(bare, k)), None)
    return None


def parse(name: str | None) -> tuple[str, str, str, str, bool] | None:
    """(sort, head, first, more, sure): of a person the surname, first name and middle names or initials; of an
    institution the place, kind and field. sure: the string itself says which part is the surname. None: no name."""
    text = unicodedata.normalize("NFKC", _MARK.sub("", name or "")).strip()
    if not text or _ET_AL.match(text):
        return None
    text = re.sub(r"\s+", " ", text).strip(" ,;.")
    shouted = text.upper() == text and len(text) > 6
    text = re.sub(r"\s*-\s*", "-", text)
    folded = fold(text)
    words = re.findall(r"[a-z][a-z'’.-]*|&", folded.replace(",", " "))
    kinds = [w for w in words if _kind(w)]
    if kinds and len(words) >= 3:
        kind = _kind(kinds[0])
        head, _, tail = folded.partition(",")
        rest = [w for w in words if w not in _SMALL]
        if tail.strip():
            place = [w for w in re.findall(r"[a-z'’.-]+", tail) if w not in _SMALL]
        else:
            rest = [w for w in rest if w not in ("the",)]
            place = rest[-1:] if rest and _kind(rest[0]) else rest[:1]
        field = [w.rstrip(".") for w in rest if w not in place and not _kind(w)]
        return ("i", key("".join(place)), kind, " ".join(re.sub(r"[^a-z]", "", w) for w in field), True)
    for _ in range(2):
        text = _DEGREE.sub("", _TITLE.sub("", text)).strip(" ,")
    if not text:
        return None

    def initials(word: str, other: bool) -> list[str] | None:
        bare = re.sub(r"[^\w]", "", word)
        if len(bare) == 1 or "." in word and len(bare) <= 3 and re.fullmatch(r"(?:\w\.?-?){1,3}", word) and all(len(x) == 1 for x in re.split(r"[.-]", word.strip("."))):
            return list(fold(bare))
        if other and 2 <= len(bare) <= 3 and bare.isupper() and not shouted:
            return list(fold(bare))
        return None

    def expand(words: list[str]) -> list[str]:
        out: list[str] = []
        for w in words:
            short = initials(w, True)
            out.extend(short if short else [key(fold(w))])
        return [w for w in out if w]

    last, comma, given = text.partition(",")
    if comma and given.strip():
        surname = key(fold(last))
        parts = expand(given.replace(",", " ").split())
        raw = fold(last)
        sure = True
    else:
        pieces = text.replace(",", " ").split()
        if len(pieces) < 2:
            return None
        back = initials(pieces[-1], True)
        if back and not initials(pieces[0], False):
            raw, parts, sure = fold(" ".join(pieces[:-1])), back, True
            if len(pieces) > 2:
                raw, parts = fold(pieces[0]), expand(pieces[1:])
        else:
            raw, parts, sure = fold(pieces[-1]), expand(pieces[:-1]), bool(initials(pieces[0], True))
        surname = key(raw)
    if not surname or not parts:
        return None
    return ("p", "-".join(key(x) for x in raw.split("-") if key(x)) or surname, parts[0], " ".join(parts[1:]), sure)


def _minus(word: Column) -> Column:
    """The word, and the word without each one of its characters."""
    n = F.length(word)
    less = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, n)))
    return F.array_distinct(F.concat(F.array(word), less))


# Natural logarithms of how likely a writer chooses a change of the kind, before any are counted; a slip is rarer than an abbreviation.
_LIKELY = {"middle": -1.2, "initial": -1.6, "nickname": -1.8, "part": -2.3, "abbreviation": -1.2, "slip": -3.9, "far": -11.0}
#: The same of a spelling that isn't established being a name of its own.
_OWN = -10.0
#: Rounds in which the likelihoods are counted, and the uses that the first values weigh as much as.
ROUNDS, PSEUDO_USES = 2, 2_000
#: Forms under one key that are compared within a group; a longer list is split.
BLOCK = 512
#: A first name is learnt to stand for another one if this share of its surnames, and so many, stand with both.
SURNAME_SHARE, LEAST_SURNAMES = 0.4, 5
# The rows of a keyboard; neighbours are found from them by rule.
_KEYBOARD = ("qwertyuiop", "asdfghjkl", "zxcvbnm")


def _neighbours() -> list[str]:
    place = {c: (row, at + row / 2) for row, keys in enumerate(_KEYBOARD) for at, c in enumerate(keys)}
    return sorted(a + b for a, (r, x) in place.items() for b, (s, y) in place.items() if a != b and abs(r - s) <= 1 and abs(x - y) <= 1)


def _change(a: Column, b: Column) -> Column:
    """0 for equal words, 1 for one slip of the hand, 2 for another single change of a letter, null for anything else."""
    places = F.sequence(F.lit(1), F.length(a))
    at = F.element_at(F.filter(places, lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1))), 1)
    near = F.concat(F.substring(a, at, F.lit(1)), F.substring(b, at, F.lit(1))).isin(_neighbours())
    swaps = F.sequence(F.lit(1), F.length(a) - 1)
    swapped = F.exists(swaps, lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.length(a))) == b)
    return (
        F.when(a == b, 0)
        .when(F.length(a) != F.length(b), F.when(F.levenshtein(a, b, 1) == 1, 1))
        .when(F.levenshtein(a, b, 1) == 1, F.when(near, 1).otherwise(2))
        .when((F.length(a) >= 2) & (F.levenshtein(a, b, 2) == 2), F.when(swapped, 1))
    )


def _words(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda w: w != "")


def _whole(first: Column) -> Column:
    """The first name and the full forms for which it stands."""
    nick = F.create_map(*[x for short in sorted(_FULL) for x in (F.lit(short), F.array(*map(F.lit, sorted(_FULL[short]))))])
    return F.array_union(F.array(first), F.coalesce(F.try_element_at(nick, first), F.array().cast("array<string>")))


def _learned_nicknames(forms: DataFrame) -> DataFrame:
    """(first, learned): first names that stand for others, by the surnames: of a nickname's surnames a large share also stand with the full
    name, of two different names' hardly any; and the full name stands with at least twice as many. Surnames of very many first names are paired in chunks."""
    people = forms.where((F.col("sort") == "p") & (F.length("first") > 1)).select("head", "first").distinct()
    spread = people.groupBy("first").agg(F.count(F.lit(1)).alias("d"))
    shared = basket_pairs(people.select(F.col("head").alias("basket"), F.col("first").alias("item"))).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_SURNAMES)
    both = shared.unionByName(shared.select(F.col("b").alias("a"), F.col("a").alias("b"), "n"))
    told = both.join(spread.withColumnRenamed("first", "a"), "a").join(spread.select(F.col("first").alias("b"), F.col("d").alias("d_b")), "b")
    told = told.where((F.col("n") >= F.col("d") * F.lit(SURNAME_SHARE)) & (F.col("d_b") >= 2 * F.col("d")))
    return told.groupBy(F.col("a").alias("first")).agg(F.array_sort(F.collect_set("b")).alias("learned"))


def _changes(pairs: DataFrame) -> DataFrame:
    """pairs of forms a and b -> the same with how many changes of each kind lead from b to a; pairs that none lead to are left out."""
    c = F.col
    zero = F.lit(0)
    head_a, head_b = F.regexp_replace("head_a", "-", ""), F.regexp_replace("head_b", "-", "")
    head, first, field = _change(head_a, head_b), _change(c("first_a"), c("first_b")), _change(F.regexp_replace("more_a", " ", ""), F.regexp_replace("more_b", " ", ""))
    place = _change(c("head_a"), c("head_b"))
    told = pairs.select("*", head.alias("d_head"), first.alias("d_first"), field.alias("d_field"), place.alias("d_place"), _words(c("more_a")).alias("w_a"), _words(c("more_b")).alias("w_b"))
    paired = F.arrays_zip(F.slice("w_a", F.lit(1), F.least(F.size("w_a"), F.size("w_b"))).alias("x"), F.slice("w_b", F.lit(1), F.least(F.size("w_a"), F.size("w_b"))).alias("y"))
    one = lambda x, y: _change(x, y).isNotNull()
    # The field of an institution, abbreviated word by word; middle names, of which either may be missing or an initial.
    shortened = (F.size("w_a") == F.size("w_b")) & F.forall(paired, lambda p: (F.length(p["x"]) >= 2) & p["y"].startswith(p["x"]) | (F.length(p["y"]) > 4) & one(p["x"], p["y"]))
    middle = F.forall(
        paired,
        lambda p: (p["x"] == p["y"]) | (F.length(p["x"]) == 1) & p["y"].startswith(p["x"]) | (F.length(p["y"]) == 1) & p["x"].startswith(p["y"]) | (F.length(p["x"]) > 4) & one(p["x"], p["y"]),
    )
    person = c("sort") == "p"
    part = person & (c("d_head") != 0) & F.array_contains(F.split("head_b", "-"), c("head_a")) | person & c("d_head").isNull() & F.array_contains(F.split("head_b", "-"), c("head_a"))
    head_slip = F.when(~person, F.when(c("d_place") == 0, 0).when(~c("own_head_a"), c("d_place"))).otherwise(
        F.when((c("d_head") == 0) | part, 0).when((F.length(head_b) > 4) & ~c("own_head_a"), c("d_head"))
    )
    initial = person & (c("first_a") != c("first_b")) & (F.length("first_a") == 1) & c("first_b").startswith(c("first_a"))
    clipped = (F.length("first_a") == 3) & c("first_b").startswith(c("first_a")) & ~c("own_first_a")
    nickname = person & (c("first_a") != c("first_b")) & ~initial & (F.arrays_overlap("whole_a", "whole_b") | clipped)
    first_slip = F.when(c("first_a") == c("first_b"), 0).when(~person, F.lit(None).cast("int")).when(initial | nickname, 0).when((F.length("first_a") > 2) & ~c("own_first_a"), c("d_first"))
    same = c("more_a") == c("more_b")
    field_slip = F.when(person | same, 0).when(c("d_field").isNotNull(), c("d_field")).when(shortened, 0)
    ones = lambda b: b.cast("int")
    counted = told.where(~person | same | middle).select(
        *pairs.columns, head_slip.alias("s1"), first_slip.alias("s2"), field_slip.alias("s3"), ones(initial).alias("initial"), ones(nickname).alias("nickname"), ones(part).alias("part"),
        ones(person & ~same).alias("middle"), ones(~person & ~same & c("d_field").isNull()).alias("abbreviation"),
    )
    slips = sum((F.when(c(s) == 1, 1).otherwise(zero) for s in ("s1", "s2", "s3")), zero)
    far = sum((F.when(c(s) == 2, 1).otherwise(zero) for s in ("s1", "s2", "s3")), zero)
    return counted.where("s1 IS NOT NULL AND s2 IS NOT NULL AND s3 IS NOT NULL").withColumn("slip", slips).withColumn("far", far)


def _attributed(scored: DataFrame, likely: dict[str, float]) -> DataFrame:
    """scored(a, b, n_a, n_b, changes) -> (a, b, n_a, changes) of each form's candidate with the greatest posterior, where it has any but itself."""
    cost = sum((F.col(k) * F.lit(v) for k, v in likely.items()), F.lit(0.0))
    rated = scored.withColumn("p", F.log("n_b") + cost).where((F.col("slip") + F.col("far") == 0) | (F.col("p") > F.log("n_a") + F.lit(_OWN)))
    return rated.groupBy("a").agg(F.max_by(F.struct("b", "n_a", *likely), F.struct("p", "b")).alias("x")).select("a", "x.*")


def _counted(scored: DataFrame, uses: int) -> dict[str, float]:
    """The logarithms of the changes' shares of all uses, counted over the attributions that they themselves lead to. Other changed letters keep
    their first value: those that are found may as well be other names, and counting them would make them likelier from round to round."""
    likely = dict(_LIKELY)
    for _ in range(ROUNDS):
        row = _attributed(scored, likely).agg(*[F.coalesce(F.sum(F.col(k) * F.col("n_a")), F.lit(0)).alias(k) for k in likely]).first()
        likely = {k: first if k == "far" else math.log((row[k] + PSEUDO_USES * math.exp(first)) / (uses + PSEUDO_USES)) for k, first in _LIKELY.items()}
    return likely


def _met(left: DataFrame, right: DataFrame, block: int) -> DataFrame:
    """left(key, a, ...), right(key, b, ...) joined on the key; a list of right rows longer than a block is split, and left rows meet each part."""
    sizes = right.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block).select("key", F.ceil(F.col("n") / F.lit(block)).cast("int").alias("parts"))
    sizes = checkpoint(sizes)
    if not sizes.limit(1).count():
        return left.join(right, "key")
    parts = F.coalesce("parts", F.lit(1))
    own = right.join(sizes, "key", "left").withColumn("part", F.pmod(F.xxhash64("b"), parts)).drop("parts")
    every = left.join(sizes, "key", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), (parts - 1).cast("long")))).drop("parts")
    return every.join(own, ["key", "part"]).drop("part")


def _established(tokens: DataFrame, least: int, counts: tuple[str, ...]) -> DataFrame:
    """tokens(sort, word, d, uses) -> (sort, word) of those with d >= least, save those of which one of the counts is no more than
    slips of a neighbour one edit away explain: a slip's share of its neighbour plus three deviations, at any size of the table."""
    share = math.exp(_LIKELY["slip"])
    able = tokens.where(F.col("d") >= least)

    def keyed(df: DataFrame, s: str) -> DataFrame:
        joined = F.regexp_replace("word", "-", "")
        keys = F.transform(_minus(joined), lambda x: F.xxhash64("sort", x))
        return df.where(F.length(joined) > 2).select("sort", *[F.col(c).alias(f"{c}_{s}") for c in ("word", "d", "uses")], joined.alias(f"joined_{s}"), F.explode(keys).alias("key"))

    met = keyed(able, "a").join(keyed(tokens, "b").drop("sort"), "key").where("joined_a != joined_b")
    explained = F.lit(False)
    for c in counts:
        slips = F.col(f"{c}_b") * F.lit(share)
        explained = explained | (F.col(f"{c}_a") <= slips + 3 * F.sqrt(slips))
    met = met.where((F.col("uses_b") > F.col("uses_a")) & explained & _change(F.col("joined_a"), F.col("joined_b")).isNotNull())
    return able.select("sort", "word").join(met.select("sort", F.col("word_a").alias("word")).distinct(), ["sort", "word"], "left_anti")


def _forms(strings: DataFrame) -> DataFrame:
    """strings(name, n) -> (name, n, sort, head, first, more), word order settled by how other strings use the words."""

    def run(batches):
        for pdf in batches:
            rows = [(n, c, *p) for n, c, p in zip(pdf["name"], pdf["n"], map(parse, pdf["name"])) if p]
            yield pd.DataFrame(rows, columns=["name", "n", "sort", "head", "first", "more", "sure"])

    parsed = checkpoint(strings.mapInPandas(run, "name string, n long, sort string, head string, first string, more string, sure boolean"))
    people = parsed.where("sort = 'p'")
    used = people.select(F.col("first").alias("word"), F.lit(1).alias("front"), "n").unionByName(people.select(F.col("head").alias("word"), F.lit(0).alias("front"), "n"))
    front = used.where(F.length("word") > 1).groupBy("word").agg((F.sum(F.col("front") * F.col("n")) / F.sum("n")).alias("front"), F.sum("n").alias("uses"))
    a = front.select(F.col("word").alias("head"), F.col("front").alias("head_front"), F.col("uses").alias("head_uses"))
    b = front.select(F.col("word").alias("first"), F.col("front").alias("first_front"), F.col("uses").alias("first_uses"))
    told = parsed.join(a, "head", "left").join(b, "first", "left")
    turned = (F.col("sort") == "p") & ~F.col("sure") & (F.col("more") == "") & (F.col("head_front") > 0.6) & ((F.col("first_front") < 0.6) | (F.col("head_uses") > 5 * F.col("first_uses")))
    return told.select(
        "name", "n", "sort",
        F.when(turned, F.col("first")).otherwise(F.col("head")).alias("head"), F.when(turned, F.col("head")).otherwise(F.col("first")).alias("first"), "more",
    )


def link_names(df: DataFrame, id_col: str, names_col: str, block: int = BLOCK) -> DataFrame:
    """(name, entity): every string of names_col that names someone or something, with the entity it is attributed to.

    Defined cases: nulls, blanks, "et al" forms and single words that name no institution are no names and give no rows; rows
    that are sent twice count once; an empty table gives none. Two strings of one entity are variants.
    """
    strings = df.select(F.col(id_col).alias("id"), F.explode(names_col).alias("name")).where("name IS NOT NULL").distinct().groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    named = checkpoint(_forms(strings))
    shape = ["sort", "head", "first", "more"]
    forms = named.groupBy(*shape).agg(F.sum("n").alias("n"))
    # Established tokens: a first name with several surnames, a surname or place with several first names or fields.
    firsts = forms.where("sort = 'p'").groupBy("sort", F.col("first").alias("word")).agg(F.count_distinct("head").alias("d"), F.sum("n").alias("uses"))
    firsts = _established(firsts, 4, ("uses", "d")).select("sort", F.col("word").alias("first"), F.lit(True).alias("own_first"))
    heads = forms.where(F.length("first") > 1).groupBy("sort", F.col("head").alias("word")).agg(F.count_distinct(F.substring("first", 1, 1)).alias("d"), F.sum("n").alias("uses"))
    heads = _established(heads, 2, ("uses",)).select("sort", F.col("word").alias("head"), F.lit(True).alias("own_head"))
    forms = forms.join(firsts, ["sort", "first"], "left").join(heads, ["sort", "head"], "left")
    forms = checkpoint(forms.select(F.xxhash64(*shape).alias("f"), *shape, "n", F.coalesce("own_first", F.lit(False)).alias("own_first"), F.coalesce("own_head", F.lit(False)).alias("own_head")))
    wholes = F.array_union(_whole(F.col("first")), F.coalesce("learned", F.array().cast("array<string>")))
    forms = checkpoint(forms.join(_learned_nicknames(forms), "first", "left").withColumn("whole", F.when(F.col("sort") == "p", wholes).otherwise(F.array("first"))).drop("learned"))
    joined = F.regexp_replace("head", "-", "")
    person, full = F.col("sort") == "p", F.length("first") > 1
    # The order in which forms may lead: established tokens first, then, of institutions, the fuller, then the more frequent; ties by number.
    rank = F.when(person, F.col("own_first").cast("int") + F.col("own_head").cast("int")).otherwise(F.least(F.length("more"), F.lit(255)))
    most = F.least(F.col("n"), F.lit((1 << 36) - 1))
    lead = F.shiftleft(rank.cast("long"), 52) + F.shiftleft(most, 16) + F.shiftleft(F.least(F.length("more"), F.lit(255)).cast("long"), 8) + F.least(F.length("first"), F.lit(255))
    plain = forms.withColumn("joined", joined).withColumn("lead", lead)
    keyed = plain.withColumn("whole", F.explode("whole"))
    k = lambda tag, *parts: F.xxhash64(F.lit(tag), *parts)
    # The same keys on both sides; each names what has to agree. Under an initial only short forms look for full ones, and clipped ones under three letters.
    row = lambda df, key, asks: df.select("f", key.alias("key"), asks.alias("asks"), (F.length("first") == 1).alias("short"), "lead")
    short, clipped, yes = F.length("first") == 1, F.length("first") == 3, F.lit(True)
    tables = [
        row(plain.where(person & full), F.explode(F.transform(_minus(F.col("first")), lambda x: k("first", F.col("joined"), x))), yes),
        row(keyed.where(person & full), k("nick", F.col("joined"), F.col("whole")), yes),
        row(keyed.where(person & full), F.explode(F.transform(_minus(F.col("joined")), lambda x: k("head", F.col("whole"), x))), yes),
        row(keyed.where(person & full & F.col("head").contains("-")), F.explode(F.transform(F.split("head", "-"), lambda x: k("nick", x, F.col("whole")))), yes),
        row(plain.where(person & full), k("three", F.col("joined"), F.substring("first", 1, 3)), clipped),
        row(keyed.where(person), k("initial", F.col("joined"), F.substring("whole", 1, 1)), short),
        row(plain.where(~person), k("place", F.col("head"), F.col("first")), yes),
        row(plain.where(~person), F.explode(F.transform(_minus(F.col("head")), lambda x: k("field", F.col("first"), F.regexp_replace("more", " ", ""), x))), yes),
    ]
    keys = tables[0]
    for t in tables[1:]:
        keys = keys.unionByName(t)
    keys = checkpoint(keys)
    left = keys.where("asks").select("key", F.col("f").alias("a"), F.col("lead").alias("lead_a"), F.col("short").alias("short_a"))
    right = keys.where(~F.col("short")).select("key", F.col("f").alias("b"), F.col("lead").alias("lead_b"))
    met = _met(left, right, block).where("a != b").where(F.col("short_a") | (F.col("lead_b") > F.col("lead_a")) | (F.col("lead_b") == F.col("lead_a")) & (F.col("b") > F.col("a")))
    met = met.select("a", "b").distinct()
    side = lambda s, *more: forms.select(F.col("f").alias(s), *more, *[F.col(c).alias(f"{c}_{s}") for c in ("head", "first", "more", "n", "own_first", "own_head", "whole")])
    pairs = met.join(side("a", "sort"), "a").join(side("b"), "b")
    scored = checkpoint(_changes(pairs).select("a", "b", "n_a", "n_b", *_LIKELY))
    uses = forms.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    best = _attributed(scored, _counted(scored, uses)).select("a", "b")
    root = written(forms.select(F.col("f").alias("a")).join(best, "a", "left").select("a", F.coalesce("b", "a").alias("b")))
    # Attributions lead to more frequent or fuller forms; following them doubles its stride until all are at their ends.
    while True:
        up = root.select(F.col("a").alias("b"), F.col("b").alias("b2"))
        root = written(root.join(up, "b").select("a", F.col("b2").alias("b"), (F.col("b2") != F.col("b")).alias("moved")), root)
        if not root.where("moved").limit(1).count():
            break
    entity = root.select(F.col("a").alias("f"), F.col("b").alias("entity"))
    return named.select("name", F.xxhash64(*shape).alias("f")).join(entity, "f").select("name", "entity")


def variant_pairs(df: DataFrame, id_col: str, names_col: str) -> DataFrame:
    """(name_a, name_b): all pairs of different strings of one entity, in code point order."""
    linked = checkpoint(link_names(df, id_col, names_col))
    pairs = basket_pairs(linked.select(F.col("entity").alias("basket"), F.col("name").alias("item")))
    return pairs.select(F.col("a").alias("name_a"), F.col("b").alias("name_b"))
