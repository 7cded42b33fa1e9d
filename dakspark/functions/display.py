"""Display forms of normalised addresses, acceptance of rewrites and repair of training labels: native Columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as X
from . import vocabulary as V

# Tokens shown in capitals, words after which a new part begins, tails of cut-off words.
ACRONYMS = (
    "ii", "iii", "iv", "vi", "vii", "viii", "ix", "x", "ncr", "uk", "usa", "uae", "jp", "mg", "hsr", "blr", "btm", "gst",
    "ecr", "omr",
)
BREAKERS = (
    "road", "street", "avenue", "lane", "layout", "post", "colony", "garden", "phase", "block", "building", "tower",
    "complex", "villa", "cross",
)
CUT_TAILS = ("karnat", "bangalor", "bengalur", "indi", "aprtment")

_STRINGS = "array<string>"
#: A letter that stands for the slash of a number while signs are dropped.
_SLASH = "ꟷ"


def _none() -> Column:
    return F.array().cast(_STRINGS)


def _shown(token: Column) -> Column:
    return F.when(token.isin(*ACRONYMS), F.upper(token)).when(token.rlike("[/0-9]"), token).otherwise(F.initcap(token))


def display_tokens(text: Column | str) -> Column:
    """Tokens of a text in normal form, numbers with slashes whole; `n n a` is n/nA and `n a` is nA."""
    held = F.regexp_replace(F.lower(X._c(text)), "(?<=[0-9])/(?=[0-9])", _SLASH)
    parts = X.tokens(X.squeeze(F.regexp_replace(F.regexp_replace(held, r"(?U)[^\w\s]", " "), "_+", " ")))
    parts = F.flatten(F.transform(parts, lambda t: F.when(t.contains(_SLASH), F.array(t)).otherwise(X.tokens(X.split_digits(t)))))
    joined = X.let(parts, _joined_numbers)
    return F.transform(joined, lambda t: F.replace(t, F.lit(_SLASH), F.lit("/")))


def _joined_numbers(parts: Column) -> Column:
    start = F.struct(_none().alias("out"), F.lit(0).alias("skip"))

    def step(s: Column, i: Column) -> Column:
        at = lambda k: F.get(parts, i + k)
        number, letter = lambda t: t.rlike("^[0-9]+$"), lambda t: t.rlike("^[a-z]$")
        pair = F.coalesce(number(at(0)) & number(at(1)) & letter(at(2)), F.lit(False))
        one = F.coalesce(number(at(0)) & letter(at(1)), F.lit(False))
        made = (
            F.when(pair, F.struct(F.concat(at(0), F.lit("/"), at(1), F.upper(at(2))).alias("t"), F.lit(2).alias("n")))
            .when(one, F.struct(F.concat(at(0), F.upper(at(1))).alias("t"), F.lit(1).alias("n")))
            .otherwise(F.struct(at(0).alias("t"), F.lit(0).alias("n")))
        )
        add = lambda m: F.struct(F.concat(s["out"], F.array(m["t"])).alias("out"), m["n"].alias("skip"))
        return F.when(s["skip"] > 0, F.struct(s["out"].alias("out"), (s["skip"] - 1).alias("skip"))).otherwise(X.let(made, add))

    places = F.when(F.size(parts) > 0, F.sequence(F.lit(0), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, start, step, lambda s: s["out"])


def display(text: Column | str) -> Column:
    """An address for display: acronyms in capitals, `No.` before a number, other words capitalised."""

    def shown(toks: Column) -> Column:
        ahead = lambda i: F.coalesce(F.get(toks, i + 1).rlike("^[0-9]+$|/"), F.lit(False))
        return F.transform(toks, lambda t, i: F.when(t == "no", F.when(ahead(i), "No.").otherwise("No")).otherwise(_shown(t)))

    return F.array_join(X.let(display_tokens(text), shown), " ")


def comma_display(text: Column | str, cities: Sequence[str] = V.CITIES, states: Sequence[str] = V.STATES) -> Column:
    """Parts with commas: house number, stretches that end at a breaker or before a number, city, state with pincode, country.

    The tail is taken off in turn: pincode, country, a state of two tokens or one, city.
    """
    whole = X.tokens(X.normalize_v1(text))
    one = [s for s in states if " " not in s]
    two = [s for s in states if s.count(" ") == 1]

    def last(s: Column, k: int = 1) -> Column:
        return F.array_join(F.slice(s["left"], F.greatest(F.size(s["left"]) - k + 1, F.lit(1)), k), " ")

    def cut(s: Column, test: Column, name: str, value: Column, n: Column | int = 1) -> Column:
        found = F.coalesce(test, F.lit(False))
        rest = F.slice(s["left"], F.lit(1), F.greatest(F.size(s["left"]) - n, F.lit(0)))
        fields = {k: s[k] for k in ("pin", "country", "state", "city")}
        fields[name] = F.when(found, value).otherwise(s[name])
        return F.struct(F.when(found, rest).otherwise(s["left"]).alias("left"), *[v.alias(k) for k, v in fields.items()])

    null = F.lit(None).cast("string")
    start = F.struct(whole.alias("left"), *[null.alias(k) for k in ("pin", "country", "state", "city")])

    def step(s: Column, turn: Column) -> Column:
        pair = last(s, 2).isin(*two) & (F.size(s["left"]) >= 2)
        size = F.when(pair, 2).otherwise(1)
        return (
            F.when(turn == 0, cut(s, last(s).rlike("^[0-9]{6}$"), "pin", last(s)))
            .when(turn == 1, cut(s, last(s) == "india", "country", last(s)))
            .when(turn == 2, cut(s, pair | last(s).isin(*one), "state", F.when(pair, last(s, 2)).otherwise(last(s)), size))
            .otherwise(cut(s, last(s).isin(*cities), "city", last(s)))
        )

    def parts(s: Column) -> Column:
        left = s["left"]
        first, second, third = (F.get(left, F.lit(k)) for k in range(3))
        number = lambda t: F.coalesce(t.rlike("^[0-9]+$"), F.lit(False))
        apart = (first == "no") & number(second) & number(third)
        glued = F.coalesce(first.rlike("^no[0-9]+$"), F.lit(False))
        base = F.substring(first, 3, 100)
        house = (
            F.when(apart, F.concat(F.lit("No. "), second, F.lit("/"), third))
            .when(glued & number(second), F.concat(F.lit("No. "), base, F.lit("/"), second))
            .when(glued, F.concat(F.lit("No. "), base))
        )
        used = F.when(apart, 3).when(glued & number(second), 2).when(glued, 1).otherwise(0)
        body = F.slice(left, used + 1, F.greatest(F.size(left) - used, F.lit(0)))
        # A part ends before a number and after a breaker: the mark tells where.
        marked = F.transform(
            body, lambda t, i: F.concat(F.when((i > 0) & (number(t) | F.get(body, i - 1).isin(*BREAKERS)), "\u0001").otherwise(" "), _shown(t))
        )
        chunks = F.transform(F.split(F.array_join(marked, ""), "\u0001"), lambda c: F.trim(c))
        chunks = F.filter(chunks, lambda c: c != "")
        area = F.nullif(F.concat_ws(" ", F.initcap(s["state"]), s["pin"]), F.lit(""))
        return F.concat(F.array(house), chunks, F.array(F.initcap(s["city"]), area, F.initcap(s["country"])))

    turns = F.array(*[F.lit(i) for i in range(4)])
    return F.array_join(F.aggregate(turns, start, step, parts), ", ")


def restore_slashes(raw: Column, corrected: Column) -> Column:
    """Numbers with a slash in the raw text, that spaces split in the corrected one, are whole again, each once."""
    found = F.regexp_extract_all(F.lower(raw), F.lit(r"\b([0-9]+(?:/[0-9a-z]+)+)\b"), F.lit(1))

    def mend(text: Column, number: Column) -> Column:
        spaced = F.concat(F.lit(" "), F.replace(number, F.lit("/"), F.lit(" ")), F.lit(" "))
        whole = F.concat(F.lit(" "), text, F.lit(" "))
        at = F.position(spaced, whole)
        return F.when(
            at > 0,
            F.trim(F.concat(F.substr(whole, F.lit(1), at), number, F.substr(whole, at + F.char_length(spaced) - 1))),
        ).otherwise(text)

    return F.aggregate(found, corrected, mend)


def proper_nouns(text: Column) -> Column:
    """Words of four letters or more that are no city, road or stop word."""
    known = (*V.CITIES, *V.ROAD_WORDS, *V.LOCALITY_WORDS, *V.STOP_WORDS)
    return F.array_distinct(F.filter(X.tokens(X.normalize_v1(text)), lambda t: t.rlike("^[a-z]{4,}$") & ~t.isin(*known)))


def merge_dropped(original: Column, rewritten: Column) -> Column:
    """The rewritten text with the proper nouns of the original that it lacks, in order of the alphabet, at its end."""
    lost = F.array_sort(F.array_except(proper_nouns(original), X.tokens(X.normalize_v1(rewritten))))
    return F.trim(F.concat_ws(" ", F.trim(rewritten), F.array_join(lost, " ")))


def replace_house_number(text: Column, number: Column) -> Column:
    """The leading house number replaced by the given one, or put before the text; no given one, no change."""
    lead = r"^\s*#?[0-9]{1,4}(?:[/-][0-9A-Za-z]+)?\b"
    return (
        F.when(number.isNull() | (number == ""), text)
        .when(text.rlike(lead), F.regexp_replace(text, F.lit(lead), number))
        .otherwise(F.concat_ws(", ", number, text))
    )


def real_house_numbers(numbers: Column, pincode: Column) -> Column:
    """Numbers without pincodes and without those of up to three digits that end the candidate's pincode."""
    ends = [F.right(pincode, F.lit(k)) for k in (2, 3, 4)]
    plain = F.filter(numbers, lambda n: F.char_length(n) != 6)
    return F.filter(plain, lambda n: ~F.coalesce((F.char_length(n) <= 3) & n.isin(*ends), F.lit(False)))


def usable_rewrite(rewritten: Column, fallback: Column) -> Column:
    """If a rewrite of a query can be used: no address of a page, a sign of an address, no cut-off tail, a number
    of the query kept, none made up, the query's long words (45 % or more) kept, no word three times, no growth past twice the length."""
    new, old = X.tokens(X.normalize_v1(rewritten)), X.tokens(X.normalize_v1(fallback))
    numbers = lambda t: X.number_tokens(t)
    sign = F.exists(new, lambda t: t.rlike("^[0-9]+$") | t.isin(*V.CITIES, *V.ROAD_WORDS))
    long = F.array_distinct(F.filter(old, lambda t: t.rlike("^[a-z]{5,}$")))
    kept = (F.size(numbers(old)) == 0) | F.arrays_overlap(numbers(old), numbers(new))
    made_up = F.size(F.array_except(numbers(new), numbers(old))) > 0
    thrice = F.exists(new, lambda t: F.size(F.filter(new, lambda u: u == t)) >= 3)
    return F.coalesce(
        ~F.lower(rewritten).rlike("https?://|www[.]")
        & (F.size(new) >= 2)
        & sign
        & ~F.element_at(new, -1).isin(*CUT_TAILS)
        & kept
        & ~made_up
        & ((F.size(long) == 0) | (F.size(F.array_intersect(long, new)) >= 0.45 * F.size(long)))
        & ~thrice
        & (F.size(new) <= 2 * F.size(old) + 2),
        F.lit(False),
    )


def history_bucket(confidence: Column) -> Column:
    return F.when(confidence >= 70, "ok").when(confidence >= 40, "warn").otherwise("bad")


def history_match(term: Column, columns: Sequence[str]) -> Column:
    """If the term is in any of the columns, letter case aside."""
    return F.contains(F.lower(F.concat_ws(" ", *columns)), F.lower(term))


def relative_time(seconds: Column) -> Column:
    """How long ago, in the largest whole unit up to days."""
    unit = lambda size, name: F.concat(F.floor(seconds / size).cast("string"), F.lit(name))
    return F.when(seconds < 60, "just now").when(seconds < 3600, unit(60, "m ago")).when(seconds < 86400, unit(3600, "h ago")).otherwise(unit(86400, "d ago"))


def bad_label(text: Column, patterns: Sequence[str] = tuple(V.MISSPELLINGS)) -> Column:
    """If a label holds a word known to be misspelled; `flour` counts after a number or an ordinal only."""
    plain = [p for p in patterns if p != "flour"]
    low = F.lower(text)
    floor = r"\b[0-9]+(?:st|nd|rd|th)?\s+flour\b"
    return F.coalesce(low.rlike(rf"\b(?:{'|'.join(plain)})\b") | low.rlike(floor), F.lit(False))


def repair_label(text: Column, repairs: Mapping[str, str] = V.MISSPELLINGS) -> Column:
    """Words and phrases of a label replaced by their usual form, the longest first; `flour` after a number only."""
    words = {k: v for k, v in repairs.items() if k != "flour"}
    mended = X.canonicalize(X.normalize_v1(text), words)
    return F.regexp_replace(mended, r"\b([0-9]+(?:st|nd|rd|th)?) flour\b", "$1 floor")


def fix_address(text: Column, cities: Sequence[str] = V.CITIES) -> Column:
    """All row repairs in one pass: spacing, glued suffixes, numbers, ordinals, runs, capped repeats, cities after cities."""
    spaced = X.split_glued(X.fix_spacing(F.lower(text)), tails=cities)
    toks = F.filter(F.split(spaced, " "), lambda t: t != "")
    return F.array_join(X.drop_known_runs(X.cap_repeats(X.drop_runs(toks)), cities), " ")


def geo_prompt(text: Column, city: Column, state: Column, pincode: Column) -> Column:
    """A model's prompt: the text, then what is known of city, state and pincode."""
    part = lambda name, c: F.when(c.isNotNull() & (F.trim(c) != ""), F.concat(F.lit(f"{name}="), F.trim(c)))
    known = F.concat_ws("; ", part("city", city), part("state", state), part("pincode", pincode))
    return F.when(known == "", text).otherwise(F.concat_ws(" | ", text, known))
