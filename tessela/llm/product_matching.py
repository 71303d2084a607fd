"""Listings of one product: standard identifiers, makers and part numbers join them; stated properties guard the groups.

1. Every listing is parsed once: all checksum-valid trade item numbers, part number and version suffix, kind (an accessory for
   something, a pack of several), and properties with a unit or a colour, brought to common units. The weight is one more property.
2. Makers are typed by people; a rare spelling goes to the frequent one that is one edit away. Listings without a part
   number get it from words of their name that, with that maker, go with one number almost always.
3. Listings of one maker, number, suffix and kind form a family. Only its different combinations of properties are looked at: first
   those of equal weight together, then those without a weight join the one group that they fit. Any differing property keeps apart.
4. Trade item numbers join groups and listings of any family, also those without maker or part number, by distributed connected
   components; a component whose members contradict each other is cut at its weakest edges.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessela.llm.components import guarded_components
from tessela.llm.cooccurrence import basket_pairs
from tessela.runtime import checkpoint, shuffle_partitions

# Units with the property they measure and their factor to its base unit.
UNITS = {
    "gb": ("memory", 1), "gigabyte": ("memory", 1), "gigabytes": ("memory", 1), "tb": ("memory", 1000), "terabyte": ("memory", 1000), "terabytes": ("memory", 1000),
    "inch": ("length", 25.4), "inches": ("length", 25.4), "in": ("length", 25.4), '"': ("length", 25.4), "″": ("length", 25.4), "mm": ("length", 1), "cm": ("length", 10),
    "m": ("length", 1000), "metre": ("length", 1000), "metres": ("length", 1000), "meter": ("length", 1000), "meters": ("length", 1000),
    "g": ("mass", 1), "gram": ("mass", 1), "grams": ("mass", 1), "kg": ("mass", 1000), "kilograms": ("mass", 1000),
    "w": ("power", 1), "watt": ("power", 1), "watts": ("power", 1), "kw": ("power", 1000),
    "ml": ("volume", 1), "cl": ("volume", 10), "l": ("volume", 1000), "ltr": ("volume", 1000), "litre": ("volume", 1000), "litres": ("volume", 1000), "liter": ("volume", 1000), "liters": ("volume", 1000),
    "min": ("time", 1), "mins": ("time", 1), "minutes": ("time", 1), "h": ("time", 60), "hr": ("time", 60), "hrs": ("time", 60), "hour": ("time", 60), "hours": ("time", 60),
    "hz": ("rate", 1), "hertz": ("rate", 1), "khz": ("rate", 1000), "mp": ("pixels", 1), "megapixel": ("pixels", 1), "megapixels": ("pixels", 1), "lm": ("light", 1), "lumen": ("light", 1), "lumens": ("light", 1),
    "v": ("voltage", 1), "volt": ("voltage", 1), "volts": ("voltage", 1), "mah": ("charge", 1), "ah": ("charge", 1000),
}
# Colour words, short forms and foreign names.
COLOURS = {
    "black": "black", "blk": "black", "noir": "black", "schwarz": "black", "negro": "black", "white": "white", "wht": "white", "blanc": "white", "weiss": "white", "blanco": "white",
    "silver": "silver", "slv": "silver", "argent": "silver", "silber": "silver", "red": "red", "rouge": "red", "rot": "red", "rojo": "red", "green": "green", "grn": "green", "vert": "green",
    "blue": "blue", "blu": "blue", "bleu": "blue", "blau": "blue", "azul": "blue", "yellow": "yellow", "ylw": "yellow", "gold": "gold", "gld": "gold", "pink": "pink", "pnk": "pink",
    "grey": "grey", "gray": "grey", "gry": "grey", "brown": "brown", "brn": "brown", "orange": "orange", "purple": "purple", "beige": "beige",
}
# Version suffixes, and company words that sellers add to a maker.
SUFFIXES = ("pro", "plus", "max", "mini", "lite", "ultra", "mk2", "mk3", "s", "x", "se")
COMPANY = re.compile(r"\b(?:inc|gmbh|ltd|llc|corp|co|ag|official|store|shop|company|brand)\b\.?", re.I)

_NUMBER = r"\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:[.,]\d+)?"
_WORD_UNITS = "|".join(sorted((u for u in UNITS if u.isalpha()), key=len, reverse=True))
_PROPERTY = re.compile(rf"(?<![\w.,-])({_NUMBER})[ -]?(?:({_WORD_UNITS})(?!\w)|([\"″]))", re.I)
_COLOUR = re.compile(r"(?<![^\W_])(" + "|".join(COLOURS) + r")(?![^\W_])", re.I)
_SUFFIX = "|".join(SUFFIXES)
_PART = re.compile(rf"(?<![^\W_])([a-z]{{2,3}})([ -]?)(\d{{3,5}})(?:[ -]?({_SUFFIX}))?(?![^\W_])(?![ -]?(?:{_WORD_UNITS})(?!\w))(?!\s?%)", re.I)
_NO_PART = frozenset(["by", "in", "of", "to", "at", "on", "no", "or", "for", "and", "the", *(u for u in UNITS if u.isalpha())])
_TRADE = re.compile(r"(?<![\d.,-])\d(?:[ -]?\d){7,13}(?![\d-])")
_FOR = re.compile(r"^(.*?)\bfor\b\s+\S", re.I)
_PACK = re.compile(r"\b(twin|double|triple)[ -]?pack\b|\b(?:set|pack|bundle|box)[ -]of[ -](\d+|two|three|four|five|six|ten)\b|\b(\d+|two|three|four)[ -]?(?:pack|pcs|pieces)\b|^\s*(\d{1,2})\s?x\s(?=[a-z])", re.I)
_COUNT = {"twin": 2, "double": 2, "triple": 3, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "ten": 10}
_OFFER = re.compile(r"\b(?:free shipping|best price|top seller|hot deal|limited offer|premium quality|100% original|with warranty|sale|new|genuine|original)\b|[*!]+", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_TOKEN = re.compile(r"[^\W\d_]{4,}")


def trade_number(digits: str) -> str | None:
    """A GTIN-8, -12, -13 or -14 with a right check digit, as 14 digits; None for anything else."""
    if len(digits) not in (8, 12, 13, 14) or len(set(digits)) == 1:
        return None
    padded = digits.zfill(14)
    weighted = sum(int(c) * (3 if i % 2 == 0 else 1) for i, c in enumerate(padded[:13]))
    return padded if (10 - weighted % 10) % 10 == int(padded[13]) else None


def _number(s: str) -> float:
    if re.fullmatch(r"\d{1,3}(?:,\d{3})+(?:\.\d+)?", s):
        return float(s.replace(",", ""))
    return float(s.replace(",", "."))


def properties(text: str) -> dict[str, str]:
    """Property -> value in base units. A property that is stated with different values counts as not stated."""
    found: dict[str, set[str]] = {}
    for value, word, sign in _PROPERTY.findall(text):
        kind, factor = UNITS[(word or sign).lower()]
        found.setdefault(kind, set()).add(str(round(_number(value) * factor)))
    for word in _COLOUR.findall(text):
        found.setdefault("colour", set()).add(COLOURS[word.lower()])
    if found.get("colour") == {"silver", "grey"}:
        found["colour"] = {"silver"}
    return {k: v.pop() for k, v in found.items() if len(v) == 1}


def maker_key(text: str | None) -> str:
    plain = unicodedata.normalize("NFKD", COMPANY.sub(" ", text or "")).casefold()
    return re.sub(r"[\W_]+", "", plain)


def parse(name: str | None, description: str | None, brand: str | None) -> tuple:
    """(maker, names, trade numbers, part number, suffix, accessory, pack, properties, words) of a listing."""
    title = unicodedata.normalize("NFKC", name or "")
    about = unicodedata.normalize("NFKC", description or "")
    both = f"{title} \n {about}"
    trade = sorted({t for t in (trade_number(re.sub(r"\D", "", x)) for x in _TRADE.findall(both)) if t})
    part, suffix = "", ""
    for m in _PART.finditer(title):
        letters = m.group(1).lower()
        # A space between leaves it open whether the letters are a word or the unit of a number before them.
        if m.group(2) == " " and (letters in COLOURS or letters in SUFFIXES or letters in _NO_PART and letters not in UNITS or letters in UNITS and title[: m.start()].rstrip()[-1:].isdigit()):
            continue
        part, suffix = letters + m.group(3), (m.group(4) or "").lower()
        break
    bare = _OFFER.sub(" ", title)
    pack = _PACK.search(bare)
    count = 1
    if pack:
        word = next(g for g in pack.groups() if g).lower()
        count = int(word) if word.isdigit() else _COUNT[word]
    before = _FOR.match(bare)
    accessory = " ".join(re.findall(r"[^\W\d_]+", before.group(1).lower())) if before else ""
    words = list(dict.fromkeys(w.lower() for w in _TOKEN.findall(_CAMEL.sub(" ", bare))))
    if not part:
        tail = re.findall(rf"(?<=[^\W\d_])[ -]+({_SUFFIX})(?![\w.])", re.sub(r"[,/|].*", "", bare), re.I)
        suffix = tail[0].lower() if tail else ""
    made = re.findall(r"\b(?:from|by)\s+([^\W\d_]{3,})", both)
    names = list(dict.fromkeys([*(maker_key(x) for x in made), *words]))
    stated = properties(both)
    return (maker_key(brand), names, trade, part, suffix, accessory, count, ";".join(f"{k}={v}" for k, v in sorted(stated.items())), words)


_PARSED = "product_id long, weight string, maker string, names array<string>, trade array<string>, part string, suffix string, accessory string, pack int, stated string, words array<string>"


def _shortened(word: Column) -> Column:
    """The word and the word without any one of its characters: two words share one of these if one edit apart."""
    n = F.length(word)
    without = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, n)))
    return F.array_distinct(F.concat(F.array(word), without))


def _spelling(counts: DataFrame, ratio: int = 5) -> DataFrame:
    """counts(word, n) -> (word, right): the most frequent word one edit away that is ratio times as frequent, else itself."""
    long = counts.where(F.length("word") >= 5)
    keys = checkpoint(long.select("word", "n", F.explode(_shortened(F.col("word"))).alias("key")))
    right = keys.select("key", F.col("word").alias("right"), F.col("n").alias("m"))
    near = keys.join(right, "key").where((F.col("word") != F.col("right")) & (F.col("m") >= F.col("n") * ratio))
    best = near.groupBy("word").agg(F.max_by("right", F.struct("m", "right")).alias("right"))
    return counts.join(best, "word", "left").select("word", F.coalesce("right", "word").alias("right"))


def _families(parsed: DataFrame) -> DataFrame:
    """Adds the right maker and the part number that a listing's words stand for."""
    makers = parsed.where("maker != ''").groupBy(F.col("maker").alias("word")).agg(F.count(F.lit(1)).alias("n"))
    right = checkpoint(_spelling(makers))
    given = parsed.join(right.withColumnRenamed("word", "maker"), "maker", "left").withColumnRenamed("right", "brand")
    # No maker's column: the first word of the listing that is some listing's maker.
    open_ = given.where("brand IS NULL").select("product_id", F.posexplode("names").alias("at", "word"))
    told = open_.join(right, "word").groupBy("product_id").agg(F.min_by("right", "at").alias("told"))
    given = checkpoint(given.join(told, "product_id", "left").withColumn("brand", F.coalesce("brand", "told", F.lit(""))).drop("told", "maker", "names"))
    words = given.where("part != '' AND brand != ''").select("brand", "part", F.explode("words").alias("word"))
    seen = words.groupBy("brand", "word", "part").agg(F.count(F.lit(1)).alias("n"))
    lines = seen.groupBy("brand", "word").agg(F.max_by("part", F.struct("n", "part")).alias("line"), F.max("n").alias("most"), F.sum("n").alias("n"))
    lines = checkpoint(lines.where((F.col("most") >= 3) & (F.col("most") >= 0.8 * F.col("n"))).select("brand", "word", "line", "n"))
    lost = checkpoint(given.where("part = '' AND brand != ''").select("product_id", "brand", F.explode("words").alias("word")))
    exact = lost.join(lines, ["brand", "word"]).groupBy("product_id", "line").agg(F.count(F.lit(1)).alias("votes"), F.min("n").alias("least"))
    vote = Window.partitionBy("product_id").orderBy(F.desc("votes"), "least", "line")
    exact = checkpoint(exact.withColumn("r", F.row_number().over(vote)).where("r = 1").select("product_id", "line"))
    rest = lost.join(exact, "product_id", "left_anti").where(F.length("word") >= 5)
    near = rest.select("product_id", "brand", "word", F.explode(_shortened(F.col("word"))).alias("key"))
    target = lines.where(F.length("word") >= 5).select("brand", "line", "n", F.explode(_shortened(F.col("word"))).alias("key"))
    fuzzy = near.join(target, ["brand", "key"]).groupBy("product_id").agg(F.max_by("line", F.struct("n", "line")).alias("line"))
    found = exact.unionByName(fuzzy)
    return given.join(found, "product_id", "left").withColumn("part", F.when(F.col("part") == "", F.coalesce("line", F.lit(""))).otherwise(F.col("part"))).drop("line")


def _apart(stated: str) -> dict[str, str]:
    return dict(x.split("=", 1) for x in stated.split(";") if x)


def _stated(properties: dict[str, str]) -> str:
    return ";".join(f"{k}={v}" for k, v in sorted(properties.items()))


class Groups:
    """Groups by the properties that their members state. Those that share a value with a new member are found by that value, those that share
    no kind of property by their kinds, so a member isn't compared with all groups."""

    def __init__(self):
        self.stated: list[dict[str, str]] = []
        self.closed: list[bool] = []
        self._by_value: dict[tuple[str, str], set[int]] = {}
        self._by_kinds: dict[frozenset, set[int]] = {}

    def add(self, properties: dict[str, str], to: int | None = None, closed: bool = False) -> int:
        """Puts a member into a group, or a new one. closed: nothing joins it."""
        if to is None:
            to = len(self.stated)
            self.stated.append({})
            self.closed.append(closed)
        elif not properties.items() - self.stated[to].items():
            return to
        held = self.stated[to]
        self._by_kinds.get(frozenset(held), set()).discard(to)
        held.update(properties)
        for item in properties.items():
            self._by_value.setdefault(item, set()).add(to)
        self._by_kinds.setdefault(frozenset(held), set()).add(to)
        return to

    def fitting(self, properties: dict[str, str]) -> list[int]:
        """The groups that contradict nothing, of those only the ones that share the most values."""
        shared: dict[int, int] = {}
        for item in properties.items():
            for g in self._by_value.get(item, ()):
                shared[g] = shared.get(g, 0) + 1
        fit = {g: n for g, n in shared.items() if all(self.stated[g].get(k, v) == v for k, v in properties.items())}
        if fit:
            most = max(fit.values())
            return sorted(g for g, n in fit.items() if n == most)
        return sorted(g for kinds, members in self._by_kinds.items() if not kinds & properties.keys() for g in members)


def join_alike(nodes: list[str]) -> tuple[list[int], list[str]]:
    """Combinations of properties that should be one product (of equal weight) -> (group numbers, what the groups state)."""
    groups, out = Groups(), [-1] * len(nodes)
    apart = [_apart(s) for s in nodes]
    for i in sorted(range(len(nodes)), key=lambda i: (-len(apart[i]), nodes[i])):
        fit = groups.fitting(apart[i])
        out[i] = groups.add(apart[i], fit[0] if fit else None)
    return out, [_stated(s) for s in groups.stated]


def attach(known: list[tuple[str, int]], nodes: list[str]) -> list[int]:
    """known: (what groups state, how many groups state just that). Nodes without a weight join the one group that they fit best; one that
    fits several stays with its equals. -> numbers: of a known group if below len(known), else of a new group."""
    groups, out = Groups(), [-1] * len(nodes)
    for stated, count in known:
        groups.add(_apart(stated), closed=count > 1)
    alone: dict[str, int] = {}
    apart = [_apart(s) for s in nodes]
    for i in sorted(range(len(nodes)), key=lambda i: (-len(apart[i]), nodes[i])):
        fit = groups.fitting(apart[i])
        if len(fit) == 1 and not groups.closed[fit[0]]:
            out[i] = groups.add(apart[i], fit[0])
        elif not fit:
            out[i] = groups.add(apart[i])
        else:
            if nodes[i] not in alone:
                alone[nodes[i]] = groups.add(apart[i])
            out[i] = alone[nodes[i]]
    return out


def _streamed(solve):
    """Rows that arrive sorted by their first column -> solve(value, rows) of each value, one at a time."""

    def run(batches):
        now, held = None, []
        for batch in batches:
            out = []
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if row[0] != now and held:
                    out.extend(solve(now, held))
                    held = []
                now = row[0]
                held.append(row)
            yield from _rows(out)
        if held:
            yield from _rows(solve(now, held))

    def _rows(out):
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*out)], ["block", "stated", "group", "sum"])

    return run


_SOLVED = "block string, stated string, group string, sum string"


def _grouped(full: DataFrame) -> DataFrame:
    """full(product_id, family, weight, stated, ...) -> (family, weight, stated, gid): the group of every combination of a family."""
    tasks = shuffle_partitions(full.sparkSession)
    combos = checkpoint(full.where("family IS NOT NULL").select("family", "weight", "stated").distinct())

    def of_weight(block, rows):
        numbers, sums = join_alike([r[1] for r in rows])
        return [(block, r[1], f"{block}|{no}", sums[no]) for r, no in zip(rows, numbers)]

    weighed = combos.where("weight != ''").select(F.concat_ws("|", "family", "weight").alias("block"), "stated")
    weighed = weighed.repartition(tasks, "block").sortWithinPartitions("block").mapInArrow(_streamed(of_weight), _SOLVED)
    block = F.concat_ws("|", "family", "weight")
    weighed = checkpoint(combos.where("weight != ''").withColumn("block", block).join(weighed, ["block", "stated"]).select("family", "weight", "stated", F.col("group").alias("gid"), "sum"))

    def of_family(block, rows):
        known = [r for r in rows if r[2] is not None]
        nodes = [r for r in rows if r[2] is None]
        numbers = attach([(r[1], r[3]) for r in known], [r[1] for r in nodes])
        return [(block, r[1], known[no][2] if no < len(known) else f"{block}||{no - len(known)}", "") for r, no in zip(nodes, numbers)]

    sums = weighed.groupBy(F.col("family").alias("block"), F.col("sum").alias("stated")).agg(F.min("gid").alias("gid"), F.count_distinct("gid").alias("n"))
    light = combos.where("weight = ''").select(F.col("family").alias("block"), "stated", F.lit(None).cast("string").alias("gid"), F.lit(0).cast("long").alias("n"))
    light = sums.join(light.select("block").distinct(), "block", "left_semi").unionByName(light)
    light = light.repartition(tasks, "block").sortWithinPartitions("block", "stated", "gid").mapInArrow(_streamed(of_family), _SOLVED)
    light = light.select(F.col("block").alias("family"), F.lit("").alias("weight"), "stated", F.col("group").alias("gid"))
    return weighed.select("family", "weight", "stated", "gid").unionByName(light)


def _joined_by_trade(listed: DataFrame) -> DataFrame:
    """listed(product_id, gid, trade, guard) -> (gid, root): groups that share a trade item number and contradict each other in nothing."""
    numbered = listed.select(F.col("gid").alias("node"), F.explode("trade").alias("key"))
    shared = numbered.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low != high").select("key")
    edges = checkpoint(numbered.join(shared, "key").groupBy("node", "key").agg(F.count(F.lit(1)).alias("support")))
    if not edges.limit(1).count():
        return edges.select(F.col("node").alias("gid"), F.col("node").alias("root"))
    nodes = edges.select(F.col("node").alias("gid")).distinct()
    pair = F.split("item", "=", 2)
    stated = listed.join(nodes, "gid", "left_semi").select(F.col("gid").alias("node"), F.explode("guard").alias("item")).distinct().select("node", pair[0].alias("kind"), pair[1].alias("value"))
    return guarded_components(edges, checkpoint(stated)).select(F.col("node").alias("gid"), F.col("component").alias("root"))


def group_listings(df: DataFrame, id_col: str = "product_id", version_col: str = "last_updated") -> DataFrame:
    """(product_id, group_id, family): one row per listing; listings of the same product share group_id.

    Reads name, description, brand and weight_kg. Defined cases: null ids are dropped; an id with several rows counts
    once, with its latest; a listing of which neither maker and part number nor a shared trade item number are known is alone in
    its group; null texts state nothing; an empty table gives no rows. Other columns are ignored. Groups are named by a 64-bit hash.
    """
    latest = F.struct(F.col(version_col).alias("v"), F.col("name"), F.col("description"), F.col("brand"), F.col("weight_kg").cast("string").alias("weight"))
    rows = df.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("product_id")).agg(F.max(latest).alias("x"))
    rows = rows.select("product_id", "x.name", "x.description", "x.brand", F.coalesce("x.weight", F.lit("")).alias("weight"))

    def run(batches):
        for pdf in batches:
            parsed = [parse(n, d, b) for n, d, b in zip(pdf["name"], pdf["description"], pdf["brand"])]
            names = ["maker", "names", "trade", "part", "suffix", "accessory", "pack", "stated", "words"]
            yield pd.concat([pdf[["product_id", "weight"]].reset_index(drop=True), pd.DataFrame(parsed, columns=names)], axis=1)

    parsed = checkpoint(rows.mapInPandas(run, _PARSED))
    full = _families(parsed)
    pack = F.col("pack").cast("string")
    family = F.when((F.col("part") != "") & (F.col("brand") != ""), F.concat_ws("|", "brand", "part", "suffix", "accessory", pack))
    told = F.filter(F.split("stated", ";"), lambda x: x != "")
    own = [F.concat(F.lit("accessory="), "accessory"), F.concat(F.lit("pack="), pack)]
    maybe = [F.when(F.col("weight") != "", F.concat(F.lit("weight="), "weight")), F.when(F.col("part") != "", F.concat(F.lit("suffix="), "suffix"))]
    guard = F.concat(told, F.array_compact(F.array(*own, *maybe)))
    full = checkpoint(full.select("product_id", family.alias("family"), "weight", "trade", "stated", guard.alias("guard")))
    single = F.concat(F.lit("single|"), F.col("product_id").cast("string"))
    listed = checkpoint(full.join(_grouped(full), ["family", "weight", "stated"], "left").select("product_id", "family", F.coalesce("gid", single).alias("gid"), "trade", "guard"))
    merged = _joined_by_trade(listed)
    return listed.join(merged, "gid", "left").select("product_id", F.xxhash64(F.coalesce("root", "gid")).alias("group_id"), "family")


def same_product_pairs(df: DataFrame, id_col: str = "product_id", version_col: str = "last_updated") -> DataFrame:
    """(product_id_a, product_id_b): all pairs of every group, smaller id first; large groups are expanded in blocks."""
    groups = checkpoint(group_listings(df, id_col, version_col).select(F.col("group_id").alias("basket"), F.col("product_id").alias("item")))
    pairs = basket_pairs(groups)
    return pairs.select(F.col("a").alias("product_id_a"), F.col("b").alias("product_id_b"))
