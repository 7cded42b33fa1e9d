"""Normalising, parsing and formatting of address text: Column in, Column out, all native."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vocabulary as V


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def words(*items: str) -> Column:
    return F.array(*[F.lit(x) for x in items])


def lookup(table: Mapping[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for pair in sorted(table.items()) for x in pair])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once a row: inside lambdas a Column is computed again wherever it stands."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# --- normalising -----------------------------------------------------------------------------------------------


def split_digits(text: Column) -> Column:
    """A space between digits and letters, but not before an ordinal's ending."""
    return F.regexp_replace(text, r"(?<=[0-9])(?!(?:st|nd|rd|th)\b)(?=[a-z])|(?<=[a-z])(?=[0-9])", " ")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize_v1(text: Column | str) -> Column:
    """Lower case, signs and underscores to spaces, digits apart from letters, single spaces."""
    plain = F.regexp_replace(F.lower(_c(text)), r"(?U)[^\w\s]", " ")
    return squeeze(split_digits(F.regexp_replace(plain, "_+", " ")))


def normalize_v2(text: Column | str, aliases: Mapping[str, str] | None = None) -> Column:
    """As v1 but keeps the slash of numbers, mends ordinals (5t, 2n, 3r) and applies aliases, if given."""
    plain = F.regexp_replace(F.lower(_c(text)), r"[,.\-_;:|\\]", " ")
    mended = plain
    for short, full in (("t", "th"), ("n", "nd"), ("r", "rd"), ("s", "st")):
        mended = F.regexp_replace(mended, rf"\b([0-9]+){short}\b", f"$1{full}")
    kept = F.regexp_replace(mended, r"(?U)[^\w\s/]", " ")
    out = squeeze(split_digits(kept))
    return canonicalize(out, aliases) if aliases else out


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    import unicodedata

    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def nfkc(text: Column | str) -> Column:
    """Compatibility forms folded.  Plain text stays in the JVM: only texts with other letters reach Python."""
    t = _c(text)
    plain = F.octet_length(t) == F.char_length(t)
    return F.when(plain, t).otherwise(_nfkc(F.when(~plain, t)))


# Devanagari letters, vowel signs and marks in Latin letters; a consonant without a sign has an a.
CONSONANTS = {
    "क": "k", "ख": "kh", "ग": "g", "घ": "gh", "ङ": "n", "च": "c", "छ": "ch", "ज": "j", "झ": "jh", "ञ": "n", "ट": "t",
    "ठ": "th", "ड": "d", "ढ": "dh", "ण": "n", "त": "t", "थ": "th", "द": "d", "ध": "dh", "न": "n", "प": "p", "फ": "ph",
    "ब": "b", "भ": "bh", "म": "m", "य": "y", "र": "r", "ल": "l", "व": "v", "श": "s", "ष": "s", "स": "s", "ह": "h",
}
VOWELS = {"अ": "a", "आ": "a", "इ": "i", "ई": "i", "उ": "u", "ऊ": "u", "ए": "e", "ऐ": "ai", "ओ": "o", "औ": "au"}
SIGNS = {"ा": "a", "ि": "i", "ी": "i", "ु": "u", "ू": "u", "े": "e", "ै": "ai", "ो": "o", "ौ": "au", "्": ""}


def transliterate(text: Column | str) -> Column:
    """Devanagari in Latin letters without marks, sign by sign; other texts as they are."""
    t = _c(text)
    bare = F.regexp_replace(F.regexp_replace(t, "[ंँ]", "n"), "[ः़]", "")
    marks = "".join(SIGNS)
    out = F.regexp_replace(bare, f"([{''.join(CONSONANTS)}])(?![{marks}])", "$1a")
    for table in (CONSONANTS, VOWELS, SIGNS):
        for letter, latin in table.items():
            out = F.replace(out, F.lit(letter), F.lit(latin))
    return F.when(t.rlike("[\u0900-\u097F]"), out).otherwise(t)


def normalize_any(text: Column | str, aliases: Mapping[str, str] | None = None) -> Column:
    """As `normalize_v2`, after compatibility forms and Devanagari."""
    return normalize_v2(transliterate(nfkc(text)), aliases)


def normalize_blocking(text: Column | str) -> Column:
    return squeeze(F.regexp_replace(F.lower(_c(text)), r"(?U)[^\w\s]", " "))


def normalize_audit(text: Column | str) -> Column:
    return squeeze(F.regexp_replace(F.lower(_c(text)), "[^a-z0-9 ]+", " "))


def tokens(text: Column | str) -> Column:
    return F.filter(F.split(_c(text), " "), lambda t: t != "")


def expand_tokens(toks: Column, cities: Mapping[str, str] = V.CITY_ALIASES, short: Mapping[str, str] = V.ABBREVIATIONS) -> Column:
    """City aliases, then abbreviations; a slash stays in numbers only."""
    city, abbr = lookup(cities), lookup(short)

    def one(t: Column) -> Column:
        bare = F.when(t.rlike("^[0-9]+/[0-9a-z]+$"), t).otherwise(F.replace(t, F.lit("/"), F.lit("")))
        named = F.coalesce(city[bare], bare)
        return F.coalesce(abbr[named], named)

    return F.filter(F.transform(toks, one), lambda t: t != "")


def canonicalize(text: Column | str, aliases: Mapping[str, str] = V.LOCALITY_ALIASES) -> Column:
    """One pass from the left, the longest phrase first; a one-token alias whose tail follows already stays."""
    # Most texts hold no alias: one test of the whole text spares them the walk.
    held = rf" (?:{'|'.join(re.escape(k) for k in aliases)}) "

    def walk(toks: Column) -> Column:
        return let(F.array_join(toks, " "), lambda t: F.when(F.concat(F.lit(" "), t, F.lit(" ")).rlike(held), _canonical(toks, aliases)).otherwise(t))

    return let(tokens(text), walk)


def _canonical(toks: Column, aliases: Mapping[str, str]) -> Column:
    table = lookup(aliases)
    most = max(len(k.split()) for k in aliases)
    heads = sorted({k.split()[0] for k in aliases})
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("skip"))

    def step(s: Column, i: Column) -> Column:
        choice = None
        for n in range(1, most + 1):
            phrase = F.array_join(F.slice(toks, i, n), " ")
            whole = i + n - 1 <= F.size(toks)
            hit = F.when(whole, table[phrase])
            if n == 1:
                tail = F.regexp_replace(hit, r"^\S+\s*", "")
                follows = F.array_join(F.slice(toks, i + 1, F.greatest(F.size(tokens(tail)), F.lit(1))), " ")
                hit = F.when((tail != "") & (follows == tail), F.lit(None)).otherwise(hit)
            own = F.when(hit.isNotNull(), F.struct(hit.alias("to"), F.lit(n).alias("n")))
            choice = own if n == 1 else F.coalesce(own, choice)
        return F.when(
            s["skip"] > 0, F.struct(s["out"].alias("out"), (s["skip"] - 1).alias("skip"))
        ).when(
            ~F.get(toks, i - 1).isin(*heads), F.struct(F.concat(s["out"], F.array(F.get(toks, i - 1))).alias("out"), F.lit(0).alias("skip"))
        ).otherwise(
            let(
                F.coalesce(choice, F.struct(F.get(toks, i - 1).alias("to"), F.lit(1).alias("n"))),
                lambda c: F.struct(F.concat(s["out"], F.array(c["to"])).alias("out"), (c["n"] - 1).alias("skip")),
            )
        )

    steps = F.when(F.size(toks) > 0, F.sequence(F.lit(1), F.size(toks))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, start, step, lambda s: F.array_join(s["out"], " "))


# --- parsing ---------------------------------------------------------------------------------------------------


def pincode(text: Column | str) -> Column:
    return F.nullif(F.regexp_extract(_c(text), r"\b([0-9]{6})\b", 1), F.lit(""))


def repair_pincode(token: Column | str) -> Column:
    """Six digits stay; five get a leading zero; of seven the first six."""
    t = _c(token)
    return (
        F.when(t.rlike("^[0-9]{6}$"), t)
        .when(t.rlike("^[0-9]{5}$"), F.concat(F.lit("0"), t))
        .when(t.rlike("^[0-9]{7}$"), F.substring(t, 1, 6))
    )


def detect_pincode(text: Column | str) -> Column:
    loose = F.nullif(F.regexp_extract(_c(text), r"\b([0-9]{7}|[0-9]{5})\b", 1), F.lit(""))
    return F.coalesce(pincode(text), repair_pincode(loose))


def number_tokens(toks: Column) -> Column:
    return F.filter(toks, lambda t: t.rlike("^[0-9]+$"))


def plain_numbers(toks: Column) -> Column:
    return F.filter(toks, lambda t: t.rlike("^[0-9]+$") & (F.char_length(t) != 6))


def first_in(toks: Column, known: Sequence[str]) -> Column:
    return F.get(F.filter(toks, lambda t: t.isin(*known)), F.lit(0))


def last_in(toks: Column, known: Sequence[str]) -> Column:
    return F.get(F.reverse(F.filter(toks, lambda t: t.isin(*known))), F.lit(0))


def before_words(toks: Column, after: Sequence[str]) -> Column:
    """The alphabetic tokens directly before one of `after`, in order."""
    at = let(toks, lambda own: F.transform(own, lambda t, i: F.when(F.get(own, i + 1).isin(*after) & t.rlike("^[a-z]+$"), t)))
    return F.array_distinct(F.filter(at, lambda t: t.isNotNull()))


def road_anchor(toks: Column) -> Column:
    return F.get(before_words(toks, V.ROAD_WORDS), F.lit(0))


def locality_anchors(toks: Column) -> Column:
    return F.array_sort(before_words(toks, V.LOCALITY_WORDS))


def informative_tokens(toks: Column) -> Column:
    return F.array_sort(
        F.array_distinct(F.filter(toks, lambda t: (F.char_length(t) >= 4) & ~t.rlike("^[0-9]+$") & ~t.isin(*V.STOP_WORDS)))
    )


def detect_state(text: Column | str, toks: Column, states: Sequence[str] = V.STATES) -> Column:
    """The longest known state that the text holds as words, or that of the city; the first by name on ties."""
    text = _c(text)
    order = sorted(states, key=lambda s: (-len(s), s))
    named = F.coalesce(*[F.when(F.concat(F.lit(" "), text, F.lit(" ")).contains(f" {s} "), s) for s in order])
    return F.coalesce(named, lookup(V.CITY_STATE)[first_in(toks, V.CITIES)])


def sub_anchors(toks: Column) -> Column:
    """A map from block, phase, sector, ... to the number before it, the first of each."""
    numbered = lambda own: F.transform(
        own,
        lambda t, i: F.when(
            t.isin(*V.SUB_ANCHOR_WORDS) & F.get(own, i - 1).rlike("^[0-9]+(?:st|nd|rd|th)?$"),
            F.struct(t.alias("word"), F.regexp_extract(F.get(own, i - 1), "^([0-9]+)", 1).alias("num")),
        ),
    )
    first = lambda own: F.filter(
        own, lambda p, i: ~F.exists(F.slice(own, F.lit(1), i), lambda q: q["word"] == p["word"])
    )
    return F.map_from_entries(let(F.filter(let(toks, numbered), lambda p: p.isNotNull()), first))


def house_number(text: Column | str) -> Column:
    text = F.lower(_c(text))
    named = F.regexp_extract(text, r"\b(?:no|flat|house|plot|door)\.?\s*#?\s*([0-9]{1,4}(?:[/-][0-9a-z]+)?)\b", 1)
    lead = F.regexp_extract(text, r"^\s*#?([0-9]{1,4}(?:[/-][0-9a-z]+)?)\b", 1)
    return F.coalesce(F.nullif(named, F.lit("")), F.nullif(lead, F.lit("")))


def parse(text: Column | str) -> Column:
    """The parsed address as a struct."""
    return let(normalize_v2(text), lambda norm: let(expand_tokens(tokens(norm)), lambda toks: _parsed(_c(text), norm, toks)))


def _parsed(text: Column, norm: Column, toks: Column) -> Column:
    return F.struct(
        text.alias("raw"),
        norm.alias("normalized"),
        toks.alias("tokens"),
        detect_pincode(norm).alias("pincode"),
        first_in(toks, V.CITIES).alias("city"),
        detect_state(norm, toks).alias("state"),
        road_anchor(toks).alias("road_anchor"),
        locality_anchors(toks).alias("locality_anchors"),
        informative_tokens(toks).alias("informative_tokens"),
        F.array_sort(F.array_distinct(number_tokens(toks))).alias("numbers"),
        sub_anchors(toks).alias("sub_anchors"),
    )


def field_warnings(text: Column | str) -> Column:
    """What an address lacks: number, street, city, pincode (or has a part of one), tokens."""
    norm = normalize_v1(text)
    toks = tokens(norm)
    pin = F.exists(toks, lambda t: t.rlike("^[0-9]{6}$"))
    part = F.exists(toks, lambda t: t.rlike("^[0-9]{4,5}$"))
    return F.array_compact(
        F.array(
            F.when(~F.exists(toks, lambda t: t.rlike("[0-9]")), "no number"),
            F.when(~F.exists(toks, lambda t: t.isin(*V.ROAD_WORDS)), "no street"),
            F.when(~F.exists(toks, lambda t: t.isin(*V.CITIES)), "no city"),
            F.when(~pin & part, "partial pincode").when(~pin, "no pincode"),
            F.when(F.size(toks) < 3, "too short"),
        )
    )


def geo_classes(toks: Column, cities: Sequence[str], areas: Sequence[str]) -> Column:
    """Tokens by class: the last city, numbers, areas, street words, others."""
    kind = lambda t: (
        F.when(t.isin(*cities), "city")
        .when(t.rlike("^[0-9]+$"), "number")
        .when(t.isin(*areas), "area")
        .when(t.isin(*V.ROAD_WORDS), "street")
        .otherwise("other")
    )
    pick = lambda k: F.filter(toks, lambda t: kind(t) == k)
    return F.struct(
        last_in(toks, cities).alias("city"), *[pick(k).alias(f"{k}s") for k in ("number", "area", "street", "other")]
    )


# --- phonetics and keys ----------------------------------------------------------------------------------------


def consonant_signature(token: Column | str) -> Column:
    return F.regexp_replace(_c(token), "[aeiou]", "")


def consonant_skeleton(token: Column | str) -> Column:
    t = _c(token)
    return F.concat(F.substring(t, 1, 1), F.regexp_replace(F.substring(t, 2, 1000), "[aeiou]", ""))


def phonetic_hash(word: Column | str) -> Column:
    """Aspirates, long vowels and doubled letters folded, vowels after the first letter dropped."""
    w = _c(word)
    out = reduce(lambda s, rule: F.replace(s, F.lit(rule[0]), F.lit(rule[1])), V.PHONETIC_RULES, F.lower(w))
    out = reduce(lambda s, rule: F.regexp_replace(s, *rule), V.PHONETIC_RUNS, out)
    out = F.replace(F.replace(out, F.lit("y"), F.lit("i")), F.lit("v"), F.lit("w"))
    out = F.regexp_replace(out, "(.)\\1+", "$1")
    return F.when(F.char_length(w) < 2, w).otherwise(consonant_skeleton(out))


def char_ngrams(token: Column | str, n: int = 3) -> Column:
    t = _c(token)
    return F.when(F.char_length(t) < n, F.array(t)).otherwise(
        F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length(t) - n + 1)), lambda i: F.substr(t, i, F.lit(n))))
    )


def ngram_containment(a: Column, b: Column, n: int = 3) -> Column:
    left = char_ngrams(a, n)
    return F.size(F.array_intersect(left, char_ngrams(b, n))) / F.size(left)


def positional_similarity(a: Column, b: Column) -> Column:
    """1 - (places that differ + difference of lengths) / the longer length."""
    la, lb = F.char_length(a), F.char_length(b)
    short = F.least(la, lb)
    wrong = F.when(
        short > 0,
        F.aggregate(
            F.sequence(F.lit(1), F.greatest(short, F.lit(1))),
            F.lit(0),
            lambda n, i: n + F.when(F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1)), 1).otherwise(0),
        ),
    ).otherwise(0)
    return 1 - (wrong + F.abs(la - lb)) / (F.greatest(la, lb) + F.lit(1e-9))


def token_overlap(a: Column, b: Column) -> Column:
    """The share of a's distinct tokens that b has; 0 without tokens."""
    left = F.array_distinct(a)
    return F.when(F.size(left) == 0, 0.0).otherwise(F.size(F.array_intersect(left, b)) / F.size(left))


def token_jaccard(a: Column, b: Column) -> Column:
    union = F.array_union(a, b)
    return F.when(F.size(union) == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(union))


def keyboard_weight(a: Column, b: Column) -> Column:
    """x1.2 for each substituted letter that lies beside, x0.2 otherwise; 1 for other lengths."""
    near = lookup(V.KEYBOARD)
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    product = F.aggregate(
        pairs,
        F.lit(1.0),
        lambda w, p: w
        * F.when(p["x"] == p["y"], 1.0)
        .when(F.contains(F.coalesce(near[p["x"]], F.lit("")), p["y"]), 1.2)
        .otherwise(0.2),
    )
    return F.when(F.char_length(a) == F.char_length(b), product).otherwise(1.0)


# --- runs and repeats ------------------------------------------------------------------------------------------


def drop_runs(toks: Column) -> Column:
    """Of equal tokens in a row the first stays."""
    return let(toks, lambda own: F.filter(own, lambda t, i: (i == 0) | (t != F.get(own, i - 1))))


def cap_repeats(toks: Column, least: int = 3, keep: int = 2) -> Column:
    """Of alphabetic tokens of three letters and more, seen `least` times or more, the first `keep` stay."""

    def stays(own: Column, t: Column, i: Column) -> Column:
        before = F.size(F.filter(F.slice(own, F.lit(1), i), lambda u: u == t))
        total = F.size(F.filter(own, lambda u: u == t))
        return ~t.rlike("^[a-z]{3,}$") | (total < least) | (before < keep)

    return let(toks, lambda own: F.filter(own, lambda t, i: stays(own, t, i)))


def drop_known_runs(toks: Column, known: Sequence[str]) -> Column:
    """A known token directly after a known token goes."""
    after_one = lambda own, t, i: t.isin(*known) & (i > 0) & F.coalesce(F.get(own, i - 1).isin(*known), F.lit(False))
    return let(toks, lambda own: F.filter(own, lambda t, i: ~after_one(own, t, i)))


def drop_known_again(toks: Column, known: Sequence[str]) -> Column:
    """A known token that equals the last known one goes, also with other tokens between."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("last"))

    def step(s: Column, t: Column) -> Column:
        is_known = t.isin(*known)
        again = is_known & (t == s["last"])
        out = F.when(again, s["out"]).otherwise(F.concat(s["out"], F.array(t)))
        return F.struct(out.alias("out"), F.when(is_known, t).otherwise(s["last"]).alias("last"))

    return F.aggregate(toks, start, step, lambda s: s["out"])


# --- formatting ------------------------------------------------------------------------------------------------

#: The order of an address's parts.
PARTS = (
    "house_no", "flat_no", "floor", "house_name", "apartment_name", "landmark", "street", "area", "town", "village",
    "district", "state", "country", "pincode",
)


def compose(parts: Sequence[str] = PARTS) -> Column:
    """The parts that aren't blank, joined by spaces."""
    return F.concat_ws(" ", *[F.nullif(F.trim(F.col(p)), F.lit("")) for p in parts])


def append_missing(body: Column, parts: Sequence[Column]) -> Column:
    """Adds each part that the text does not hold yet, in title case."""
    return with_missing(F.initcap(body), parts)


def with_missing(body: Column, parts: Sequence[Column]) -> Column:
    """As `append_missing`, the body as it is.  A fold: each step holds the text so far once, not in copies."""
    return F.aggregate(
        F.array(*parts),
        body,
        lambda out, p: F.when(p.isNull() | F.contains(F.lower(out), F.lower(p)), out).otherwise(F.concat_ws(", ", out, F.initcap(p))),
    )


def strip_plus_code(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(_c(text), r"\b[23456789CFGHJMPQRVWX]{4,8}\+[23456789CFGHJMPQRVWX]{2,3}\b,?\s*", ""))


def replace_pincode(text: Column, pin: Column) -> Column:
    return F.when(pin.isNull(), text).when(
        text.rlike(r"\b[0-9]{6}\b"), F.regexp_replace(text, F.lit(r"\b[0-9]{6}\b"), pin)
    ).otherwise(F.concat_ws(" ", text, pin))


def percent(value: Column | str) -> Column:
    """Up to 1 is a share, more is a percentage; whole, 0 to 100."""
    v = _c(value)
    return F.greatest(F.lit(0), F.least(F.lit(100), F.round(F.when(v <= 1, v * 100).otherwise(v)).cast("int")))


def changed_tokens(before: Column, after: Column) -> Column:
    """Pairs (src, dst) of tokens that differ by place, for token lists of equal length; else none."""
    pairs = F.zip_with(before, after, lambda a, b: F.struct(a.alias("src"), b.alias("dst")))
    return F.when(F.size(before) == F.size(after), F.filter(pairs, lambda p: p["src"] != p["dst"])).otherwise(
        F.array().cast("array<struct<src:string,dst:string>>")
    )


# --- spacing repairs -------------------------------------------------------------------------------------------


def fix_spacing(text: Column | str) -> Column:
    """Commas followed by a space, digits apart from words, ordinals whole, no doubled spaces."""
    out = F.regexp_replace(_c(text), r",(?=\S)", ", ")
    out = F.regexp_replace(out, r"\b([0-9]+) (st|nd|rd|th)\b", "$1$2")
    out = F.regexp_replace(out, r"([0-9])(?!(?:st|nd|rd|th)\b)([a-z]{3,})", "$1 $2")
    return squeeze(F.regexp_replace(out, r"([a-z]{3,})([0-9])", "$1 $2"))


def split_glued(text: Column | str, heads: Sequence[str] = V.ROAD_WORDS + V.LOCALITY_WORDS, tails: Sequence[str] = V.CITIES) -> Column:
    """A suffix word glued to a city gets its space back."""
    return F.regexp_replace(_c(text), rf"\b([a-z]*(?:{'|'.join(heads)}))({'|'.join(tails)})\b", "$1 $2")


def join_pincode(text: Column | str, pin: Column) -> Column:
    """Digits of the known pincode that spaces split are joined again."""
    spaced = F.array_join(F.split(pin, ""), "\\s*")
    return F.when(pin.rlike("^[0-9]{6}$"), F.regexp_replace(_c(text), F.concat(F.lit("\\b"), spaced, F.lit("\\b")), pin)).otherwise(_c(text))


def issues(text: Column | str) -> Column:
    """Labels of what is wrong with an address."""
    text = F.lower(_c(text))
    toks = tokens(squeeze(F.regexp_replace(text, ",", " ")))
    known = lambda names: F.size(F.filter(toks, lambda t: t.isin(*names)))
    glued = lambda a, b: text.rlike(rf"\b[a-z]*(?:{'|'.join(a)})(?:{'|'.join(b)})\b")
    tests = {
        "dup_token": F.size(drop_runs(toks)) < F.size(toks),
        "glued_city": glued(V.LOCALITY_WORDS, V.CITIES),
        "glued_road": glued(V.ROAD_WORDS, V.CITIES),
        "glued_pincode": text.rlike(r"[a-z][0-9]{6}\b"),
        "glued_number": text.rlike(r"\b[0-9]+(?!(?:st|nd|rd|th)\b)[a-z]{3,}"),
        "bad_ordinal": text.rlike(r"\b[0-9]+ (?:st|nd|rd|th)\b"),
        "dup_city": known(V.CITIES) > F.size(F.array_distinct(F.filter(toks, lambda t: t.isin(*V.CITIES)))),
        "comma_no_space": text.rlike(r",\S"),
        "triple_token": F.exists(toks, lambda t: t.rlike("^[a-z]{3,}$") & (F.size(F.filter(toks, lambda u: u == t)) >= 3)),
    }
    return F.array_compact(F.array(*[F.when(test, name) for name, test in tests.items()]))
