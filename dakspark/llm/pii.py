"""Format-preserving pseudonyms of personal numbers and dates, in DataFrame functions only.

Values are found by shape and validated (check digits, ranges, calendar); a validated value is permuted
by a keyed Feistel network within its own format, so the pseudonym is valid as well, equal values get
equal pseudonyms in every document, and different ones stay different.  Nothing is looked up or
shuffled: the pseudonym is a function of key and value.

Kinds: `card` (13 to 19 digits in a row, or in fours, or 4-6-5 and 4-6-4, with a right Luhn digit),
`phone` (a number written with +, whose country follows from its digits, so that separators don't
matter; or ten digits as (212) 555-0123, 212-555-0123, 212.555.0123, which are country 1's), `ip` (four
numbers up to 255), `ssn` (AAA-GG-SSSS with allowed areas), `iban` (right check digits, in one piece or
in blocks of four), `date` (yyyy-mm-dd, mm/dd/yyyy, dd.mm.yyyy in DATE_DAYS days from DATE_FROM: one day
has one pseudonym in all three), `email` (letters and digits of the name and of the host, in lower
case; signs and the ending stay).

The key comes from the session's configuration (KEY_CONF) or the caller.  Without one a random key is
made for the session: pseudonyms then link within it only.

Defined cases: null text stays null; a value that fails validation stays as it is; overlapping shapes
are taken from the left; rows that repeat an id are handled each on its own; an empty table stays
empty; all columns stay, and where a column `pii` is there already, the new one has the first free
name of `pii_1`, `pii_2`, ...
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 8
KEY_CONF = "spark.dakspark.pii.key"
DATE_FROM, DATE_SIDE = "1900-01-01", 270
DATE_DAYS = DATE_SIDE * DATE_SIDE

#: Shapes, the first that fits from the left; none touches a letter, digit or joining sign outside.
SHAPES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [0-9]{1,3})?)(?![A-Za-z0-9])",
    "phone": r"(?<![A-Za-z0-9+])\+(?:1[ .-]?\(?[2-9][0-9]{2}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}"
    r"|[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4})(?![0-9]|\.[0-9])"
    r"|(?<![A-Za-z0-9+.(-])(?:\([2-9][0-9]{2}\) ?[0-9]{3}-[0-9]{4}|[2-9][0-9]{2}-[0-9]{3}-[0-9]{4}|[2-9][0-9]{2}\.[0-9]{3}\.[0-9]{4})(?![0-9-]|\.[0-9])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9/-]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9-])(?:[0-9]{13,19}|[0-9]{4}(?: [0-9]{4}){3}(?: [0-9]{1,3}(?![0-9/.]))?|[0-9]{4}(?: [0-9]{4}){3}|[0-9]{4}(?:-[0-9]{4}){3}"
    r"|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5})(?![0-9]|-[0-9])",
}
# The country codes of two digits; those that begin with 1 or 7 have one digit, all others three.
TWO_DIGIT_COUNTRIES = (
    "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52",
    "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92",
    "93", "94", "95", "98",
)
ANY = "|".join(f"(?:{x})" for x in SHAPES.values())


def digits_permuted(digits: Column, key: str, tag: Column) -> Column:
    """A permutation of all strings of as many digits, up to 36: the halves of the string are the two sides."""
    n = F.char_length(digits)
    m = F.floor(n / 2).cast("int")
    left_size = F.pow(F.lit(10.0), m).cast("decimal(20,0)").cast("long")
    right_size = F.pow(F.lit(10.0), n - m).cast("decimal(20,0)").cast("long")
    start = F.struct(
        F.coalesce(F.substr(digits, F.lit(1), m).try_cast("long"), F.lit(0).cast("long")).alias("l"),
        F.coalesce(F.substr(digits, m + 1, n - m).try_cast("long"), F.lit(0).cast("long")).alias("r"),
    )
    return F.aggregate(
        F.array(start),
        F.lit(""),
        lambda _, s: _joined(_rounds(s, left_size, right_size, key, F.concat(tag, n.cast("string"))), m, n - m),
    )


def _joined(s: Column, m: Column, k: Column) -> Column:
    return F.concat(
        F.when(m > 0, F.lpad(s["l"].cast("string"), m, "0")).otherwise(""), F.lpad(s["r"].cast("string"), k, "0")
    )


def _rounds(s: Column, left_size: Column, right_size: Column, key: str, tag: Column) -> Column:
    """The halves after ROUNDS turns; each turn adds keyed noise of one half to the other."""

    def turn(h: Column, i: Column) -> Column:
        def noise(half: Column, below: Column) -> Column:
            seed = F.concat_ws("|", F.lit(key), tag, i.cast("string"), half.cast("string"))
            return F.pmod(F.conv(F.substring(F.sha2(seed, 256), 1, 15), 16, 10).cast("long"), below)

        return F.when(
            i % 2 == 0, F.struct(F.pmod(h["l"] + noise(h["r"], left_size), left_size).alias("l"), h["r"].alias("r"))
        ).otherwise(F.struct(h["l"].alias("l"), F.pmod(h["r"] + noise(h["l"], right_size), right_size).alias("r")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), s, turn)


def _numbers(text: Column) -> Column:
    """The string's digits as an array of ints."""
    return F.transform(F.split(text, ""), lambda c: F.coalesce(c.try_cast("int"), F.lit(0)))


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a string of digits whose last digit is the check digit."""
    return F.aggregate(
        _numbers(F.reverse(digits)),
        F.struct(F.lit(0).alias("i"), F.lit(0).alias("s")),
        lambda had, x: F.struct(
            (had["i"] + 1).alias("i"),
            (
                had["s"]
                + F.when(had["i"] % 2 == 0, x).otherwise(F.when(x * 2 > 9, x * 2 - 9).otherwise(x * 2))
            ).alias("s"),
        ),
        lambda end: end["s"],
    )


def _mod97(digits: Column) -> Column:
    return F.aggregate(_numbers(digits), F.lit(0), lambda r, x: (r * 10 + x) % 97)


def _iban_number(iban: Column) -> Column:
    """The IBAN, its first four signs last, with letters as numbers."""
    turned = F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4)))
    return F.array_join(
        F.transform(
            F.split(turned, ""),
            lambda c: F.when(c.rlike("[A-Z]"), (F.ascii(c) - 55).cast("string")).otherwise(c),
        ),
        "",
    )


def _spread(pattern: Column, digits: Column) -> Column:
    """`pattern` with its digits replaced, in order, by `digits`."""
    signs = F.split(pattern, "")
    return F.aggregate(
        signs,
        F.struct(F.lit(0).alias("i"), F.lit("").alias("s")),
        lambda had, c: F.when(
            c.rlike("[0-9]"),
            F.struct((had["i"] + 1).alias("i"), F.concat(had["s"], F.substr(digits, had["i"] + 1, F.lit(1))).alias("s")),
        ).otherwise(F.struct(had["i"].alias("i"), F.concat(had["s"], c).alias("s"))),
        lambda end: end["s"],
    )


def _spaced(pattern: Column, signs: Column) -> Column:
    """`signs` with the spaces of `pattern`."""
    return F.aggregate(
        F.split(pattern, ""),
        F.struct(F.lit(0).alias("i"), F.lit("").alias("s")),
        lambda had, c: F.when(c == " ", F.struct(had["i"].alias("i"), F.concat(had["s"], c).alias("s"))).otherwise(
            F.struct((had["i"] + 1).alias("i"), F.concat(had["s"], F.substr(signs, had["i"] + 1, F.lit(1))).alias("s"))
        ),
        lambda end: end["s"],
    )


def _day(value: Column) -> Column:
    """The day of a date in one of its three forms, null if there is none."""
    return F.coalesce(F.try_to_date(value, "yyyy-MM-dd"), F.try_to_date(value, "MM/dd/yyyy"), F.try_to_date(value, "dd.MM.yyyy"))


def country_length(digits: Column) -> Column:
    """How many of a phone number's digits are its country's code."""
    return F.when(F.substring(digits, 1, 1).isin("1", "7"), 1).when(F.substring(digits, 1, 2).isin(*TWO_DIGIT_COUNTRIES), 2).otherwise(3)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def kind_of(value: Column) -> Column:
    """The kind of a found value, null if it isn't valid."""
    digits = _digits(value)
    out = F.lit(None).cast("string")
    parts = F.split(value, "\\.")
    days = F.datediff(_day(value), F.lit(DATE_FROM).cast("date"))
    bare = F.replace(value, F.lit(" "), F.lit(""))
    checks = {
        "card": (luhn_sum(digits) % 10 == 0) & ~value.contains("+") & F.char_length(digits).between(13, 19),
        "ip": F.forall(parts, lambda x: F.coalesce(x.try_cast("int"), F.lit(999)) <= 255),
        "ssn": ~value.rlike("^(000|666|9..)|-00-|-0000$"),
        "date": F.coalesce(days.between(0, DATE_DAYS - 1), F.lit(False)),
        "phone": F.char_length(digits).between(8, 15) & F.when(value.startswith("+1"), digits.rlike("^1[2-9][0-9]{9}$")).otherwise(True),
        "iban": F.char_length(bare).between(15, 34) & (_mod97(_iban_number(bare)) == 1),
        "email": F.lit(True),
    }
    for kind in reversed(SHAPES):
        whole = "^(?:" + SHAPES[kind] + ")$"
        out = F.when(value.rlike(whole) & checks[kind], kind).otherwise(out)
    return out


def pseudonym(value: Column, kind: Column, key: str) -> Column:
    """The keyed permutation of a valid value within its format."""
    digits = _digits(value)
    n = F.char_length(digits)

    def card() -> Column:
        body = digits_permuted(F.substr(digits, F.lit(1), n - 1), key, F.lit("card"))
        last = F.pmod(F.lit(10) - luhn_sum(F.concat(body, F.lit("0"))) % 10, F.lit(10)).cast("string")
        return _spread(value, F.concat(body, last))

    def ip() -> Column:
        parts = F.transform(F.split(value, "\\."), lambda x: x.cast("long"))
        start = F.struct((parts[0] * 256 + parts[1]).alias("l"), (parts[2] * 256 + parts[3]).alias("r"))
        side = F.lit(65536).cast("long")
        return F.aggregate(
            F.array(start),
            F.lit(""),
            lambda _, s0: F.aggregate(
                F.array(_rounds(s0, side, side, key, F.lit("ip"))),
                F.lit(""),
                lambda _, s: F.concat_ws(
                    ".",
                    F.floor(s["l"] / 256).cast("string"),
                    (s["l"] % 256).cast("string"),
                    F.floor(s["r"] / 256).cast("string"),
                    (s["r"] % 256).cast("string"),
                ),
            ),
        )

    def date() -> Column:
        days = F.datediff(_day(value), F.lit(DATE_FROM).cast("date")).cast("long")
        side = F.lit(DATE_SIDE).cast("long")
        start = F.struct(F.floor(days / DATE_SIDE).cast("long").alias("l"), (days % DATE_SIDE).alias("r"))

        def shown(day: Column) -> Column:
            slashed, dotted = F.date_format(day, "MM/dd/yyyy"), F.date_format(day, "dd.MM.yyyy")
            return F.when(value.contains("/"), slashed).when(value.contains("."), dotted).otherwise(day.cast("string"))

        return F.aggregate(
            F.array(start),
            F.lit(""),
            lambda _, s0: F.aggregate(
                F.array(_rounds(s0, side, side, key, F.lit("date"))),
                F.lit(""),
                lambda _, s: shown(F.date_add(F.lit(DATE_FROM).cast("date"), (s["l"] * DATE_SIDE + s["r"]).cast("int"))),
            ),
        )

    def ssn() -> Column:
        """Areas 001 to 899 but 666, groups and serials from 1: 898 * 99 areas and groups, 9999 serials."""
        area = F.substr(value, F.lit(1), F.lit(3)).cast("long")
        place = area - F.when(area > 666, 2).otherwise(1)
        group = F.substr(value, F.lit(5), F.lit(2)).cast("long") - 1
        serial = F.substr(value, F.lit(8), F.lit(4)).cast("long") - 1
        start = F.struct((place * 99 + group).alias("l"), serial.alias("r"))
        sizes = F.lit(898 * 99).cast("long"), F.lit(9999).cast("long")

        def shown(s: Column) -> Column:
            at = F.floor(s["l"] / 99)
            return F.concat_ws(
                "-",
                F.lpad((at + F.when(at >= 665, 2).otherwise(1)).cast("string"), 3, "0"),
                F.lpad((s["l"] % 99 + 1).cast("string"), 2, "0"),
                F.lpad((s["r"] + 1).cast("string"), 4, "0"),
            )

        return F.aggregate(
            F.array(start),
            F.lit(""),
            lambda _, s0: F.aggregate(F.array(_rounds(s0, *sizes, key, F.lit("ssn"))), F.lit(""), lambda _, s: shown(s)),
        )

    def phone() -> Column:
        """The country stays; in country 1 areas from 200 to 999 move among each other, and the seven digits behind them."""
        whole = F.when(value.startswith("+"), digits).otherwise(F.concat(F.lit("1"), digits))
        lead = country_length(whole)
        country, rest = F.substr(whole, F.lit(1), lead), F.substr(whole, lead + 1, n)
        start = F.struct(
            (F.substring(rest, 1, 3).try_cast("long") - 200).alias("l"), F.substring(rest, 4, 7).try_cast("long").alias("r")
        )
        sizes = F.lit(800).cast("long"), F.lit(10_000_000).cast("long")
        north = F.aggregate(
            F.array(start),
            F.lit(""),
            lambda _, s0: F.aggregate(
                F.array(_rounds(s0, *sizes, key, F.lit("phone1"))),
                F.lit(""),
                lambda _, s: F.concat((s["l"] + 200).cast("string"), F.lpad(s["r"].cast("string"), 7, "0")),
            ),
        )
        moved = F.when((country == "1") & rest.rlike("^[2-9][0-9]{9}$"), north).otherwise(
            digits_permuted(rest, key, F.concat(F.lit("phone"), country))
        )
        return _spread(value, F.when(value.startswith("+"), F.concat(country, moved)).otherwise(moved))

    def iban() -> Column:
        bare = F.replace(value, F.lit(" "), F.lit(""))
        country, body = F.substr(bare, F.lit(1), F.lit(2)), F.substr(bare, F.lit(5))
        moved = _spread(body, digits_permuted(_digits(body), key, F.concat(F.lit("iban"), country)))
        check = F.lit(98) - _mod97(_iban_number(F.concat(country, F.lit("00"), moved)))
        return _spaced(value, F.concat(country, F.lpad(check.cast("string"), 2, "0"), moved))

    def email() -> Column:
        """Letters move among letters and digits among digits: the name by the host, then the host by the name, in turn."""
        name, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
        ending = F.substring_index(domain, ".", -1)
        host = F.substr(domain, F.lit(1), F.char_length(domain) - F.char_length(ending) - 1)
        start = F.struct(F.lower(name).alias("l"), F.lower(host).alias("r"))

        def moved(text: Column, seed: Column) -> Column:
            noise = F.sha2(seed, 512)
            signs = F.transform(
                F.split(text, ""),
                lambda c, i: F.when(
                    c.rlike("[a-z]"),
                    F.char(97 + (F.ascii(c) - 97 + F.conv(F.substr(noise, (i % 40) * 3 + 1, F.lit(3)), 16, 10).cast("int")) % 26),
                )
                .when(
                    c.rlike("[0-9]"),
                    ((F.ascii(c) - 48 + F.conv(F.substr(noise, (i % 40) * 3 + 1, F.lit(3)), 16, 10).cast("int")) % 10).cast("string"),
                )
                .otherwise(c),
            )
            return F.array_join(signs, "")

        def turn(h: Column, i: Column) -> Column:
            seed = lambda half: F.concat_ws("|", F.lit(key), F.lit("email"), ending, i.cast("string"), half)
            return F.when(i % 2 == 0, F.struct(moved(h["l"], seed(h["r"])).alias("l"), h["r"].alias("r"))).otherwise(
                F.struct(h["l"].alias("l"), moved(h["r"], seed(h["l"])).alias("r"))
            )

        return F.aggregate(
            F.sequence(F.lit(0), F.lit(ROUNDS - 1)),
            start,
            turn,
            lambda h: F.concat(h["l"], F.lit("@"), h["r"], F.lit("."), ending),
        )

    out = F.lit(None).cast("string")
    for name, made in (("card", card), ("ip", ip), ("date", date), ("ssn", ssn), ("phone", phone), ("iban", iban), ("email", email)):
        out = F.when(kind == name, made()).otherwise(out)
    return out


def found_values(text: Column, key: str) -> Column:
    """Structs (value, kind, pseudonym) of a text's shapes, in order; kind is null for invalid ones."""
    return F.transform(
        F.transform(
            F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda v: F.struct(v.alias("value"), kind_of(v).alias("kind"))
        ),
        lambda x: F.struct(
            x["value"].alias("value"), x["kind"].alias("kind"), pseudonym(x["value"], x["kind"], key).alias("pseudonym")
        ),
    )


def session_key(spark: SparkSession) -> str:
    """The configured key; without one a random key, which the session then keeps."""
    if not spark.conf.get(KEY_CONF, None):
        spark.conf.set(KEY_CONF, secrets.token_hex(16))
    return spark.conf.get(KEY_CONF)


def pseudonymise(docs: DataFrame, key: str | None = None, column: str = "text") -> DataFrame:
    """`docs` with the valid values of `column` replaced, and with the column `pii`: (value, kind, pseudonym)."""
    key = key or session_key(docs.sparkSession)
    have = {c.lower() for c in docs.columns}
    name = next(x for x in ("pii", *(f"pii_{i}" for i in range(1, len(have) + 2))) if x not in have)
    found = docs.withColumn(name, found_values(F.col(column), key))
    between = F.split(F.col(column), ANY, -1)
    filled = F.transform(F.col(name), lambda x: F.coalesce(x["pseudonym"], x["value"]))
    text = F.concat(
        F.array_join(
            F.transform(
                F.arrays_zip(F.slice(between, F.lit(1), F.size(name)).alias("a"), filled.alias("b")),
                lambda x: F.concat(x["a"], x["b"]),
            ),
            "",
        ),
        F.element_at(between, -1),
    )
    plain = F.coalesce(F.size(name) == 0, F.lit(True))
    return found.withColumn(column, F.when(plain, F.col(column)).otherwise(text))


def pseudonymised_documents(spark, sf_dir: str, key: str | None = None) -> DataFrame:
    """op6: every document with its pseudonymised text and what was replaced, by kind."""
    from .common import read_table

    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    valid = F.filter("pii", lambda x: x["kind"].isNotNull())
    return pseudonymise(docs, key).select(
        "doc_id",
        F.coalesce(F.size(valid), F.lit(0)).cast("long").alias("n_replaced"),
        F.array_sort(F.array_distinct(F.transform(valid, lambda x: x["kind"]))).alias("kinds"),
        F.transform(valid, lambda x: x["pseudonym"]).alias("pseudonyms"),
        "text",
    )
