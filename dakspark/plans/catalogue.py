"""Queries by name over whole tables, and the SQL that each is held against where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as X
from ..functions import vocabulary as V
from ..operators import blocking, correction, evaluation, lexicon, matching, quality, ranking, retrieval, spelling, tables
from ..sources import readers
from ..sources.writers import shared_dir, staged
from ..streaming import feedback
from .corpus import ADDRESS_SQL, CITIES, NOISY_SQL, addresses, noisy_addresses, parsed, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return add


# --- pieces of SQL ---------------------------------------------------------------------------------------------


def _norm(x: str) -> str:
    s = f"regexp_replace(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '_+', ' ', 'g')"
    s = f"regexp_replace({s}, '([0-9])((?:st|nd|rd|th)\\b)', '\\1' || chr(2) || '\\2', 'g')"
    s = f"replace(regexp_replace(regexp_replace({s}, '([0-9])([a-z])', '\\1 \\2', 'g'), '([a-z])([0-9])', '\\1 \\2', 'g'), chr(2), '')"
    return f"trim(regexp_replace({s}, '\\s+', ' ', 'g'))"


def _toks(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda t: t <> '')"


def _in(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


def _before(toks: str, names) -> str:
    """Alphabetic tokens directly before one of the names."""
    return (
        f"list_distinct(list_filter(list_transform(range(1, len({toks})), lambda i: CASE WHEN {toks}[i + 1] IN {_in(names)} "
        f"AND regexp_full_match({toks}[i], '[a-z]+') THEN {toks}[i] END), lambda t: t IS NOT NULL))"
    )


WORDS = "regexp_extract_all(lower(text), '[a-z]+')"


def words(column: str = "text"):
    return F.regexp_extract_all(F.lower(column), F.lit("[a-z]+"), F.lit(0))


def asked(rows: DataFrame, key: str) -> DataFrame:
    """The stated query set of a search: rows whose id is divisible by 100, against all rows."""
    return rows.where(F.col(key) % 100 == 0)


# --- normalising and parsing -----------------------------------------------------------------------------------


@query("normalize_v1", f"WITH {ADDRESS_SQL} SELECT addr_id, {_norm('text')} AS normalized FROM addr")
def _(spark, sf):
    return addresses(spark, sf).select("addr_id", X.normalize_v1("text").alias("normalized"))


@query("normalize_documents", f"SELECT doc_id, {_norm('text')} AS normalized FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.normalize_v1("text").alias("normalized"))


@query(
    "normalize_audit",
    f"WITH {ADDRESS_SQL} SELECT addr_id, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9 ]+', ' ', 'g'), '\\s+', ' ', 'g')) AS normalized FROM addr",
)
def _(spark, sf):
    return addresses(spark, sf).select("addr_id", X.normalize_audit("text").alias("normalized"))


@query(
    "normalize_v2",
    f"WITH {ADDRESS_SQL} SELECT addr_id, {_norm('text')} AS normalized FROM addr",
)
def _(spark, sf):
    return addresses(spark, sf).select("addr_id", X.normalize_v2("text").alias("normalized"))


@query(
    "alias_canonicalize",
    f"WITH {ADDRESS_SQL} SELECT addr_id, regexp_replace(regexp_replace({_norm('text')}, '\\bmiddle east\\b', 'west asia', 'g'), "
    "'\\bbuilding road\\b', 'bldg street', 'g') AS canonical FROM addr",
)
def _(spark, sf):
    aliases = {"middle east": "west asia", "building road": "bldg street"}
    return addresses(spark, sf).select("addr_id", X.canonicalize(X.normalize_v1("text"), aliases).alias("canonical"))


@query(
    "parse_fields",
    f"""WITH {ADDRESS_SQL}, t AS (SELECT addr_id, text, {_toks(_norm('text'))} AS toks FROM addr)
SELECT addr_id, nullif(regexp_extract(text, '\\b([0-9]{{6}})\\b', 1), '') AS pincode,
  list_filter(toks, lambda t: t IN {_in(CITIES)})[1] AS city, {_before('toks', V.ROAD_WORDS)}[1] AS road_anchor,
  array_to_string(list_sort({_before('toks', V.LOCALITY_WORDS)}), ' ') AS localities,
  array_to_string(list_sort(list_distinct(list_filter(toks, lambda t: regexp_full_match(t, '[0-9]+')))), ' ') AS numbers FROM t""",
)
def _(spark, sf):
    toks = X.tokens(X.normalize_v1("text"))
    rows = addresses(spark, sf).select("addr_id", "text", toks.alias("toks"))
    t = F.col("toks")
    return rows.select(
        "addr_id",
        X.pincode("text").alias("pincode"),
        X.first_in(t, CITIES).alias("city"),
        X.road_anchor(t).alias("road_anchor"),
        F.array_join(X.locality_anchors(t), " ").alias("localities"),
        F.array_join(F.array_sort(F.array_distinct(X.number_tokens(t))), " ").alias("numbers"),
    )


@query(
    "pincode_repair",
    """WITH t AS (SELECT p_partkey, CAST((p_partkey * 7919) % 10000000 AS VARCHAR) AS token FROM part)
SELECT p_partkey, token, CASE length(token) WHEN 6 THEN token WHEN 5 THEN '0' || token WHEN 7 THEN substr(token, 1, 6) END AS repaired FROM t""",
)
def _(spark, sf):
    token = ((F.col("p_partkey") * 7919) % 10000000).cast("string")
    rows = table(spark, sf, "part").select("p_partkey", token.alias("token"))
    return rows.withColumn("repaired", X.repair_pincode("token"))


@query(
    "house_number",
    f"WITH {ADDRESS_SQL} SELECT addr_id, regexp_extract(text, '^No ([0-9]+)', 1) AS house_number FROM addr",
)
def _(spark, sf):
    return addresses(spark, sf).select("addr_id", X.house_number("text").alias("house_number"))


@query(
    "geo_classes",
    f"""WITH {ADDRESS_SQL}, t AS (SELECT addr_id, {_toks(_norm('text'))} AS toks FROM addr)
SELECT addr_id, list_filter(toks, lambda t: t IN {_in(CITIES)})[-1] AS city,
  len(list_filter(toks, lambda t: regexp_full_match(t, '[0-9]+'))) AS n_numbers,
  len(list_filter(toks, lambda t: t IN {_in(V.ROAD_WORDS)})) AS n_streets FROM t""",
)
def _(spark, sf):
    rows = addresses(spark, sf).select("addr_id", X.tokens(X.normalize_v1("text")).alias("toks"))
    found = rows.select("addr_id", X.geo_classes(F.col("toks"), CITIES, ()).alias("g"))
    return found.select(
        "addr_id", "g.city", F.size("g.numbers").cast("long").alias("n_numbers"), F.size("g.streets").cast("long").alias("n_streets")
    )


@query(
    "field_warnings",
    f"""WITH {ADDRESS_SQL}, t AS (SELECT addr_id, {_toks(_norm('text'))} AS toks FROM addr)
SELECT addr_id, CASE WHEN len(list_filter(toks, lambda t: t IN {_in(V.CITIES)})) = 0 THEN 'no city' ELSE '' END AS warnings FROM t""",
)
def _(spark, sf):
    return addresses(spark, sf).select("addr_id", F.array_join(X.field_warnings("text"), ",").alias("warnings"))


# --- keys and native similarity --------------------------------------------------------------------------------

PART_WORDS = "w AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS word FROM part)"


def part_words(spark, sf):
    return table(spark, sf, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("word")).distinct()


def _phonetic_sql() -> str:
    s = "word"
    for a, b in V.PHONETIC_RULES:
        s = f"replace({s}, '{a}', '{b}')"
    for a, b in V.PHONETIC_RUNS:
        s = f"regexp_replace({s}, '{a}', '{b}', 'g')"
    s = f"replace(replace({s}, 'y', 'i'), 'v', 'w')"
    for c in "abcdefghijklmnopqrstuvwxyz":
        s = f"regexp_replace({s}, '{c}{c}+', '{c}', 'g')"
    return s


@query(
    "phonetic_hash",
    f"WITH {PART_WORDS}, h AS (SELECT word, {_phonetic_sql()} AS s FROM w) SELECT word, CASE WHEN length(word) < 2 THEN word "
    "ELSE substr(s, 1, 1) || regexp_replace(substr(s, 2), '[aeiou]', '', 'g') END AS hash FROM h",
)
def _(spark, sf):
    return part_words(spark, sf).select("word", X.phonetic_hash("word").alias("hash"))


@query(
    "consonant_keys",
    f"WITH {PART_WORDS} SELECT word, regexp_replace(word, '[aeiou]', '', 'g') AS signature, "
    "substr(word, 1, 1) || regexp_replace(substr(word, 2), '[aeiou]', '', 'g') AS skeleton FROM w",
)
def _(spark, sf):
    return part_words(spark, sf).select(
        "word", X.consonant_signature("word").alias("signature"), X.consonant_skeleton("word").alias("skeleton")
    )


NAME_PAIRS = """n AS (SELECT DISTINCT lower(p_name) AS name FROM part), k AS (SELECT name, unnest(string_split(name, ' ')) AS t FROM n),
p AS (SELECT DISTINCT x.name AS a, y.name AS b FROM k x JOIN k y ON x.t = y.t)"""


def name_pairs(spark, sf):
    """Names of parts that share a word."""
    names = table(spark, sf, "part").select(F.lower("p_name").alias("name")).distinct()
    keyed = names.select("name", F.explode(F.split("name", " ")).alias("t"))
    return keyed.select(F.col("name").alias("a"), "t").join(keyed.select(F.col("name").alias("b"), "t"), "t").select("a", "b").distinct()


@query(
    "pair_features",
    f"""WITH {NAME_PAIRS}, g AS (SELECT a, b, string_split(a, ' ') AS ta, string_split(b, ' ') AS tb,
  list_distinct(list_transform(range(1, length(a) - 1), lambda i: substr(a, CAST(i AS INT), 3))) AS ga,
  list_distinct(list_transform(range(1, length(b) - 1), lambda i: substr(b, CAST(i AS INT), 3))) AS gb FROM p)
SELECT a, b, round(len(list_intersect(ga, gb)) / len(ga), 6) AS containment,
  round(len(list_intersect(list_distinct(ta), tb)) / len(list_distinct(ta)), 6) AS overlap,
  round(len(list_intersect(ta, tb)) / len(list_distinct(list_concat(ta, tb))), 6) AS jaccard,
  round(1 - (len(list_filter(range(1, least(length(a), length(b)) + 1), lambda i: substr(a, CAST(i AS INT), 1) <> substr(b, CAST(i AS INT), 1)))
    + abs(length(a) - length(b))) / (greatest(length(a), length(b)) + 1e-9), 6) AS positional FROM g""",
)
def _(spark, sf):
    ta, tb = F.split("a", " "), F.split("b", " ")
    return name_pairs(spark, sf).select(
        "a",
        "b",
        F.round(X.ngram_containment(F.col("a"), F.col("b")), 6).alias("containment"),
        F.round(X.token_overlap(ta, tb), 6).alias("overlap"),
        F.round(X.token_jaccard(ta, tb), 6).alias("jaccard"),
        F.round(X.positional_similarity(F.col("a"), F.col("b")), 6).alias("positional"),
    )


_LCS = """list_reduce(list_prepend(list_transform(range(0, length(b) + 1), lambda i: CAST(0 AS BIGINT)),
  list_transform(string_split(a, ''), lambda c: [CAST(unicode(c) AS BIGINT)])),
  lambda row, c: list_reduce(list_prepend([CAST(0 AS BIGINT)], list_transform(range(1, length(b) + 1), lambda j: [j])),
    lambda acc, j: list_append(acc, CASE WHEN unicode(substr(b, CAST(j[1] AS INT), 1)) = c[1] THEN row[j[1]] + 1
      ELSE greatest(row[j[1] + 1], acc[j[1]]) END)))[-1]"""


@query("indel_ratio", f"WITH {NAME_PAIRS} SELECT a, b, round(200.0 * {_LCS} / (length(a) + length(b)), 4) AS ratio FROM p")
def _(spark, sf):
    return name_pairs(spark, sf).select("a", "b", F.round(S.indel_ratio("a", "b"), 4).alias("ratio"))


@query("token_ratios")
def _(spark, sf):
    pairs = name_pairs(spark, sf)
    return pairs.select(
        "a",
        "b",
        F.round(S.token_sort_ratio("a", "b"), 4).alias("token_sort"),
        F.round(S.token_set_ratio("a", "b"), 4).alias("token_set"),
        F.round(S.partial_ratio("a", "b"), 4).alias("partial"),
        F.round(S.w_ratio("a", "b"), 4).alias("weighted"),
    )


# --- statistics ------------------------------------------------------------------------------------------------


@query(
    "token_counts",
    f"WITH t AS (SELECT unnest({WORDS}) AS token FROM documents) SELECT token, count(*) AS n FROM t WHERE length(token) >= 2 GROUP BY token",
)
def _(spark, sf):
    return lexicon.token_counts(table(spark, sf, "documents"), words())


@query(
    "area_tokens",
    f"WITH t AS (SELECT unnest({WORDS}) AS token FROM documents) SELECT token, count(*) AS n FROM t WHERE length(token) > 3 "
    f"AND token NOT IN {_in(V.STOP_WORDS + V.CITIES)} GROUP BY token HAVING count(*) >= 5",
)
def _(spark, sf):
    return lexicon.areas(lexicon.token_counts(table(spark, sf, "documents"), words()))


@query(
    "context_weights",
    f"""WITH {ADDRESS_SQL}, t AS (SELECT {_toks(_norm('text'))} AS toks FROM addr),
p AS (SELECT unnest(list_transform(range(1, len(toks) + 1), lambda i: {{'a': toks[i], 'b': toks[i + 1]}})) AS p FROM t)
SELECT p.a AS token, CAST(sum(CASE WHEN p.b IN {_in(V.ROAD_WORDS)} THEN 3 ELSE 0 END) AS BIGINT) AS road_weight,
  CAST(sum(CASE WHEN p.b IN {_in(V.LOCALITY_WORDS)} THEN 3 ELSE 0 END) AS BIGINT) AS locality_weight,
  CAST(sum(2) AS BIGINT) AS geo_weight FROM p WHERE regexp_full_match(p.a, '[a-z]{{3,}}') GROUP BY 1""",
)
def _(spark, sf):
    rows = addresses(spark, sf).select(X.tokens(X.normalize_v1("text")).alias("toks"))
    return lexicon.context_weights(rows, "toks")


@query(
    "bigram_counts",
    f"""WITH t AS (SELECT {WORDS} AS w FROM documents),
p AS (SELECT unnest(list_transform(range(1, len(w)), lambda i: {{'a': w[i], 'b': w[i + 1]}})) AS p FROM t),
o AS (SELECT first, count(*) AS n_first FROM (SELECT unnest(w) AS first FROM t) GROUP BY first)
SELECT p.a AS first, p.b AS second, count(*) AS n, any_value(o.n_first) AS n_first FROM p JOIN o ON p.a = o.first GROUP BY p.a, p.b""",
)
def _(spark, sf):
    return lexicon.bigrams(table(spark, sf, "documents").select(words().alias("w")), "w").select("first", "second", "n", "n_first")


@query(
    "mine_misspellings",
    f"""WITH {ADDRESS_SQL}, {NOISY_SQL}, t AS (SELECT {_toks(_norm('noisy'))} AS x, {_toks(_norm('text'))} AS y FROM noisy),
d AS (SELECT unnest(list_filter(list_transform(range(1, len(x) + 1), lambda i: {{'s': x[i], 'd': y[i]}}), lambda p: p.s <> p.d)) AS p
  FROM t WHERE len(x) = len(y)),
c AS (SELECT p.s AS src, p.d AS dst, count(*) AS n FROM d WHERE regexp_full_match(p.s, '[a-z]{{3,}}') AND regexp_full_match(p.d, '[a-z]{{3,}}') GROUP BY 1, 2),
r AS (SELECT *, CAST(sum(n) OVER (PARTITION BY src) AS BIGINT) AS total, row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) AS k FROM c)
SELECT src, dst, n, total FROM r WHERE k = 1 AND n >= 3 AND n >= 0.6 * total
  AND src NOT IN {_in((*V.CITIES, *V.ROAD_WORDS, *V.LOCALITY_WORDS, *V.STOP_WORDS, *V.MISSPELLINGS))}""",
)
def _(spark, sf):
    toks = lambda c: X.tokens(X.normalize_v1(c))
    rows = noisy_addresses(spark, sf).select(toks("noisy").alias("noisy"), toks("text").alias("clean"))
    return lexicon.mine_misspellings(rows)


VOCABULARY = f"""v AS (SELECT token, count(*) AS n FROM (SELECT unnest({_toks(_norm('text'))}) AS token FROM addr) WHERE regexp_full_match(token, '[a-z]{{2,}}') GROUP BY token)"""
NOISY_WORDS = f"""x AS (SELECT DISTINCT word FROM (SELECT unnest({_toks(_norm('noisy'))}) AS word FROM noisy) WHERE regexp_full_match(word, '[a-z]{{2,}}'))"""


def vocabulary_and_words(spark, sf):
    toks = lambda c: X.tokens(X.normalize_v1(c))
    rows = noisy_addresses(spark, sf)
    vocabulary = lexicon.token_counts(rows, toks("text"))
    seen = rows.select(F.explode(toks("noisy")).alias("word")).where(F.col("word").rlike("^[a-z]{2,}$")).distinct()
    return vocabulary, seen


def _keys(a: str, b: str) -> str:
    near = " " + " ".join(k + n for k, own in V.KEYBOARD.items() for n in own) + " "
    one = f"CASE WHEN substr({a}, CAST(i AS INT), 1) = substr({b}, CAST(i AS INT), 1) THEN 1.0 WHEN contains('{near}', ' ' || substr({a}, CAST(i AS INT), 1) || substr({b}, CAST(i AS INT), 1) || ' ') THEN 1.2 ELSE 0.2 END"
    return f"CASE WHEN length({a}) = length({b}) THEN list_aggregate(list_transform(range(1, length({a}) + 1), lambda i: CAST({one} AS DOUBLE)), 'product') ELSE 1.0 END"


#: The noisy words, and known words with their second letter changed, or that and one letter lost.
MANY_WORDS = f"""{NOISY_WORDS}, m AS (SELECT word FROM x UNION SELECT substr(token, 1, 1) || 's' || substr(token, 3) FROM v WHERE length(token) >= 4
  UNION SELECT substr(token, 1, 1) || 'w' || substr(token, 3, length(token) - 3) FROM v WHERE length(token) >= 5)"""


def many_words(spark, sf):
    vocabulary, seen = vocabulary_and_words(spark, sf)
    t, n = F.col("token"), F.char_length("token")
    changed = vocabulary.where(n >= 4).select(F.concat(F.substring(t, 1, 1), F.lit("s"), F.substr(t, F.lit(3), n)).alias("word"))
    shorter = vocabulary.where(n >= 5).select(F.concat(F.substring(t, 1, 1), F.lit("w"), F.substr(t, F.lit(3), n - 3)).alias("word"))
    return seen.unionByName(changed).unionByName(shorter).distinct()


@query(
    "edit_neighbours",
    f"WITH {ADDRESS_SQL}, {NOISY_SQL}, {VOCABULARY}, {NOISY_WORDS} SELECT word, token AS near, n FROM x JOIN v ON damerau_levenshtein(word, token) = 1",
)
def _(spark, sf):
    vocabulary, seen = vocabulary_and_words(spark, sf)
    return spelling.edit_neighbours(seen, vocabulary)


@query(
    "norvig_correct",
    f"""WITH {ADDRESS_SQL}, {NOISY_SQL}, {VOCABULARY}, {MANY_WORDS}, y AS (SELECT word, token, n, damerau_levenshtein(word, token) AS d FROM m JOIN v ON damerau_levenshtein(word, token) <= 2
  WHERE word NOT IN (SELECT token FROM v)),
r AS (SELECT word, token, row_number() OVER (PARTITION BY word ORDER BY d, round(n * {_keys('word', 'token')}, 9) DESC, token) AS k FROM y)
SELECT m.word, coalesce(r.token, m.word) AS corrected FROM m LEFT JOIN r ON m.word = r.word AND r.k = 1""",
)
def _(spark, sf):
    vocabulary, _ = vocabulary_and_words(spark, sf)
    return spelling.norvig_correct(many_words(spark, sf), vocabulary)


@query(
    "edit_neighbours_two",
    f"WITH {ADDRESS_SQL}, {NOISY_SQL}, {VOCABULARY}, {MANY_WORDS} SELECT word, token AS near, n FROM m JOIN v ON damerau_levenshtein(word, token) = 2",
)
def _(spark, sf):
    vocabulary, _ = vocabulary_and_words(spark, sf)
    return spelling.edit_neighbours_two(many_words(spark, sf), vocabulary)


@query(
    "keyboard_weight",
    f"WITH {PART_WORDS} SELECT a.word AS a, b.word AS b, round({_keys('a.word', 'b.word')}, 9) AS weight FROM w a JOIN w b ON length(a.word) = length(b.word)",
)
def _(spark, sf):
    rows = part_words(spark, sf)
    pairs = rows.select(F.col("word").alias("a"), F.char_length("word").alias("n")).join(rows.select(F.col("word").alias("b"), F.char_length("word").alias("n")), "n")
    return pairs.select("a", "b", F.round(X.keyboard_weight(F.col("a"), F.col("b")), 9).alias("weight"))


@query("correct_tokens")
def _(spark, sf):
    vocabulary, _ = vocabulary_and_words(spark, sf)
    rows = noisy_addresses(spark, sf).select("addr_id", X.tokens(X.normalize_v1("noisy")).alias("toks"))
    fixed = spelling.correct_tokens(rows, "addr_id", "toks", vocabulary)
    return fixed.select("addr_id", F.array_join("corrected", " ").alias("corrected"), F.size("changes").alias("n_changes"))


# --- retrieval -------------------------------------------------------------------------------------------------


@query(
    "keyword_block",
    f"""WITH {ADDRESS_SQL}, d AS (SELECT DISTINCT addr_id, unnest({_toks('lower(text)')}) AS term FROM addr),
q AS (SELECT addr_id AS query_id, list_distinct([street, city]) AS terms FROM addr WHERE addr_id % 100 = 0),
t AS (SELECT query_id, least(len(terms), 2) AS least, unnest(terms) AS term FROM q),
c AS (SELECT query_id, addr_id, least, count(*) AS block_score FROM t JOIN d USING (term) GROUP BY 1, 2, 3),
r AS (SELECT query_id, addr_id, block_score, row_number() OVER (PARTITION BY query_id ORDER BY block_score DESC, addr_id) AS rank FROM c WHERE block_score >= least)
SELECT query_id, addr_id, block_score, rank FROM r WHERE rank <= 200""",
)
def _(spark, sf):
    rows = addresses(spark, sf)
    asks = asked(rows, "addr_id").select(F.col("addr_id").alias("query_id"), F.array_distinct(F.array("street", "city")).alias("terms"))
    return blocking.keyword_block(asks, rows.select("addr_id", F.lower("text").alias("text")))


@query(
    "geo_cascade",
    f"""WITH {ADDRESS_SQL}, q AS (SELECT addr_id AS query_id, CASE WHEN addr_id % 200 = 0 THEN NULL ELSE pin END AS pincode,
  CASE WHEN addr_id % 300 = 0 THEN NULL ELSE city END AS city, CASE WHEN addr_id % 700 = 0 THEN 'unknown' ELSE street END AS street FROM addr WHERE addr_id % 100 = 0),
m AS (SELECT query_id, addr_id, CASE WHEN a.pin = q.pincode AND a.city = q.city AND a.street = q.street THEN 1
  WHEN a.city = q.city AND a.street = q.street THEN 2 WHEN a.pin = q.pincode AND a.city = q.city THEN 3
  WHEN a.pin = q.pincode THEN 4 WHEN a.city = q.city THEN 5 END AS tier FROM q JOIN addr a ON a.pin = q.pincode OR a.city = q.city),
b AS (SELECT query_id, min(tier) AS tier FROM m GROUP BY 1)
SELECT m.query_id, b.tier, m.addr_id FROM m JOIN b USING (query_id) WHERE m.tier = b.tier OR (b.tier = 2 AND m.tier <= 2) OR (b.tier = 4 AND m.tier <= 4)
  OR b.tier = 5""",
)
def _(spark, sf):
    rows = addresses(spark, sf)
    none = F.lit(None).cast("string")
    asks = asked(rows, "addr_id").select(
        F.col("addr_id").alias("query_id"),
        F.when(F.col("addr_id") % 200 == 0, none).otherwise(F.col("pin")).alias("pincode"),
        F.when(F.col("addr_id") % 300 == 0, none).otherwise(F.col("city")).alias("city"),
        F.when(F.col("addr_id") % 700 == 0, F.lit("unknown")).otherwise(F.col("street")).alias("street"),
    )
    return blocking.geo_cascade(asks, rows.withColumnRenamed("pin", "pincode").drop("text"))


BM25_SQL = f"""d AS (SELECT doc_id, {WORDS} AS toks FROM documents), n AS (SELECT count(*) AS docs, avg(len(toks)) AS mean_len FROM d),
tf AS (SELECT doc_id, term, len, count(*) AS tf FROM (SELECT doc_id, len(toks) AS len, unnest(toks) AS term FROM d) GROUP BY 1, 2, 3),
df AS (SELECT term, ln(docs - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf, n GROUP BY term, docs),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM df) ELSE raw END AS idf FROM df),
q AS (SELECT item_id AS query_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({WORDS}) AS term FROM benchmark) GROUP BY 1, 2),
s AS (SELECT query_id, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean_len))), 6) AS score
  FROM q JOIN idf USING (term) JOIN tf USING (term), n GROUP BY 1, 2)"""


def bm25_scores(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", words().alias("toks"))
    asks = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), words().alias("terms"))
    return retrieval.bm25(asks, docs)


@query(
    "bm25_topk",
    f"WITH {BM25_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) "
    "SELECT query_id, doc_id, score, rank FROM r WHERE rank <= 10",
)
def _(spark, sf):
    return retrieval.top_k(bm25_scores(spark, sf), 10, "doc_id").select("query_id", "doc_id", "score", "rank")


DENSE_SQL = """v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, v.vec_id AS vec_id, round(list_inner_product(q.e, v.e), 6) AS score FROM v q, v WHERE q.vec_id % 100 = 0)"""


def dense(spark, sf):
    rows = table(spark, sf, "embeddings")
    asks = asked(rows, "vec_id").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return retrieval.dense_scores(asks, rows.select("vec_id", "embedding"))


@query(
    "dense_topk",
    f"WITH {DENSE_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) "
    "SELECT query_id, vec_id, score, rank FROM r WHERE rank <= 10",
)
def _(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding")
    asks = asked(rows, "vec_id").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return retrieval.dense_top_k(asks, rows, 10).select("query_id", "vec_id", "score", "rank")


@query(
    "minmax_fusion",
    f"""WITH {DENSE_SQL}, w AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS o, label FROM embeddings),
b AS (SELECT s.query_id, s.vec_id, CASE WHEN a.label = c.label THEN 1.0 ELSE 0.5 END AS score FROM s JOIN embeddings a ON a.vec_id = s.query_id JOIN embeddings c ON c.vec_id = s.vec_id),
m AS (SELECT query_id, vec_id, CASE WHEN max(score) OVER q = min(score) OVER q THEN 1.0 ELSE (score - min(score) OVER q) / (max(score) OVER q - min(score) OVER q) END * 0.5 AS score
  FROM s WINDOW q AS (PARTITION BY query_id)
  UNION ALL SELECT query_id, vec_id, CASE WHEN max(score) OVER q = min(score) OVER q THEN 1.0 ELSE (score - min(score) OVER q) / (max(score) OVER q - min(score) OVER q) END * 0.2
  FROM b WINDOW q AS (PARTITION BY query_id)),
f AS (SELECT query_id, vec_id, round(sum(score), 5) AS score FROM m GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM f)
SELECT query_id, vec_id, score, rank FROM r WHERE rank <= 20""",
)
def _(spark, sf):
    scores = dense(spark, sf).withColumn("score", F.round("score", 6))
    labels = table(spark, sf, "embeddings").select("vec_id", "label")
    kinds = scores.join(labels, "vec_id").join(
        labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("asked")), "query_id"
    )
    second = kinds.select("query_id", "vec_id", F.when(F.col("label") == F.col("asked"), 1.0).otherwise(0.5).alias("score"))
    fused = retrieval.fuse({"dense": scores, "label": second}, {"dense": 0.5, "label": 0.2}, "vec_id")
    return retrieval.top_k(fused, 20, "vec_id", digits=5).select("query_id", "vec_id", "score", "rank")


@query(
    "prefix_search",
    f"""WITH {ADDRESS_SQL}, q AS (SELECT addr_id AS query_id, substr(street, 1, 4) AS prefix FROM addr WHERE addr_id % 100 = 0),
w AS (SELECT DISTINCT addr_id, lower(text) AS text, unnest(string_split(lower(text), ' ')) AS word FROM addr),
h AS (SELECT query_id, text, min(addr_id) AS addr_id FROM q JOIN w ON starts_with(word, prefix) GROUP BY 1, 2),
r AS (SELECT query_id, addr_id, row_number() OVER (PARTITION BY query_id ORDER BY addr_id) AS rank FROM h)
SELECT query_id, addr_id, rank FROM r WHERE rank <= 10""",
)
def _(spark, sf):
    rows = addresses(spark, sf)
    asks = asked(rows, "addr_id").select(F.col("addr_id").alias("query_id"), F.substring("street", 1, 4).alias("prefix"))
    return retrieval.prefix_matches(asks, rows).select("query_id", "addr_id", "rank")


# --- matching --------------------------------------------------------------------------------------------------


def matched(spark, sf):
    """Noisy queries, spelled by the corpus's vocabulary, and the corpus, both parsed: a query has nothing but its text."""
    rows = noisy_addresses(spark, sf)
    vocabulary = lexicon.token_counts(rows, X.tokens(X.normalize_v1("text")))
    noisy = rows.select("addr_id", X.tokens(X.normalize_v1("noisy")).alias("toks"))
    spelled = spelling.correct_tokens(noisy, "addr_id", "toks", vocabulary).select(
        F.col("addr_id").alias("query_id"), F.array_join("corrected", " ").alias("text")
    )
    asks = parsed(staged(spelled, "spelled"), "text")
    known = parsed(rows.select("addr_id", X.normalize_v1("text").alias("text")), "text")
    return asks, known


@query("match_addresses")
def _(spark, sf):
    asks, known = matched(spark, sf)
    return matching.match_addresses(asks, known)


@query("hit_at_k")
def _(spark, sf):
    asks, known = matched(spark, sf)
    ranked = correction.ranked_matches(asks, known)
    return evaluation.hit_rates(ranked, asks.select("query_id", F.col("query_id").alias("true_id")))


@query(
    "structured_gate",
    f"""WITH {ADDRESS_SQL}, t AS (SELECT addr_id, street, pin, {_toks(_norm('text'))} AS toks FROM addr),
f AS (SELECT *, list_filter(toks, lambda t: regexp_full_match(t, '[0-9]+') AND length(t) <> 6) AS nums, {_before('toks', V.LOCALITY_WORDS)} AS locs FROM t)
SELECT q.addr_id AS query_id, c.addr_id, q.street = c.street AND (len(list_intersect(q.nums, c.nums)) > 0
  OR len(list_filter(q.nums, lambda n: NOT (length(n) <= 3 AND n IN (right(c.pin, 2), right(c.pin, 3), right(c.pin, 4))))) = 0)
  AND (len(q.locs) = 0 OR len(c.locs) = 0 OR len(list_intersect(q.locs, c.locs)) > 0) AS allowed
FROM f q JOIN f c ON q.pin = c.pin WHERE q.addr_id % 100 = 0""",
)
def _(spark, sf):
    rows = parsed(addresses(spark, sf), "text")
    asks = asked(rows, "addr_id").select(F.col("addr_id").alias("query_id"), "pin", F.col("parsed").alias("q"))
    pairs = asks.join(rows.select("addr_id", "pin", F.col("parsed").alias("c")), "pin")
    return pairs.select("query_id", "addr_id", matching.structured_gate(F.col("q"), F.col("c")).alias("allowed"))


@query(
    "final_confidence",
    """WITH s AS (SELECT o_orderkey, (o_orderkey % 100) / 100.0 AS score, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 0.85 END AS prec,
  o_orderkey % 2 = 0 AS valid, o_orderkey % 5 <> 0 AS cons, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey % 4 <> 0 END AS agrees FROM orders),
a AS (SELECT *, CASE WHEN prec IS NOT NULL THEN least(1.0, score + 0.05 * prec) ELSE score * 0.9 END AS c FROM s),
b AS (SELECT *, CASE WHEN valid THEN least(1.0, c + 0.05) ELSE c END AS d FROM a),
e AS (SELECT *, CASE WHEN valid AND NOT cons THEN d * 0.7 ELSE d END AS f FROM b),
g AS (SELECT *, CASE WHEN agrees THEN least(1.0, f + 0.05) WHEN NOT agrees THEN f * 0.85 ELSE f END AS h FROM e)
SELECT o_orderkey, round(h, 6) AS confidence, CASE WHEN prec IS NOT NULL AND h >= 0.9 THEN 'verified' WHEN h >= 0.9 THEN 'high_confidence'
  WHEN h >= 0.65 THEN 'medium_confidence' ELSE 'low_confidence' END AS status FROM g""",
)
def _(spark, sf):
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(
        "o_orderkey",
        ((k % 100) / 100.0).alias("score"),
        F.when(k % 3 != 0, 0.85).alias("prec"),
        F.when(k % 7 != 0, k % 4 != 0).alias("agrees"),
    )
    c = matching.final_confidence(F.col("score"), F.col("prec"), k % 2 == 0, k % 5 != 0, F.col("agrees"))
    return rows.withColumn("c", c).select(
        "o_orderkey", F.round("c", 6).alias("confidence"), matching.status(F.col("c"), F.col("prec").isNotNull()).alias("status")
    )


@query(
    "generated_confidence",
    """SELECT o_orderkey, round(least(0.95, 0.30 + CASE WHEN o_orderkey % 2 = 0 THEN 0.20 ELSE 0 END + CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 = 0 THEN 0.10 ELSE 0 END
  + CASE WHEN o_orderkey % 5 = 0 THEN 0.20 ELSE 0 END + 0.05 * (o_orderkey % 4) + 0.10 * ((o_orderkey % 10) / 10.0)), 6) AS confidence FROM orders""",
)
def _(spark, sf):
    k = F.col("o_orderkey")
    c = matching.generated_confidence(k % 2 == 0, k % 3 == 0, k % 5 == 0, k % 4, (k % 10) / 10.0)
    return table(spark, sf, "orders").select("o_orderkey", F.round(c, 6).alias("confidence"))


@query(
    "pincode_anchor",
    """SELECT o_orderkey, round(CASE WHEN o_orderkey % 3 = 0 THEN least(1.0, s + 0.2) WHEN o_orderkey % 3 = 1 THEN greatest(0.0, s - 0.1) ELSE s END, 6) AS score
FROM (SELECT o_orderkey, (o_orderkey % 100) / 100.0 AS s FROM orders)""",
)
def _(spark, sf):
    k = F.col("o_orderkey")
    other = F.when(k % 3 == 0, F.lit("560001")).when(k % 3 == 1, F.lit("560002"))
    score = ranking.pincode_anchor((k % 100) / 100.0, F.lit("560001"), other)
    return table(spark, sf, "orders").select("o_orderkey", F.round(score, 6).alias("score"))


@query(
    "rerank_features",
    f"""WITH {NAME_PAIRS}, t AS (SELECT a, b, string_split(a, ' ') AS x, string_split(b, ' ') AS y FROM p)
SELECT a, b, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) AS token_overlap,
  CAST(0.5 AS DOUBLE) AS pincode_match, round(least(len(x), len(y)) / greatest(len(x), len(y)), 6) AS length_ratio,
  round(0.3 * 0.5 + 0.4 * 0.25 + 0.3 * (len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))), 6) AS blend FROM t""",
)
def _(spark, sf):
    rows = name_pairs(spark, sf).select("a", "b", F.split("a", " ").alias("x"), F.split("b", " ").alias("y"))
    own = rows.withColumns(ranking.native_features("x", "y"))
    blend = ranking.blend_score(F.lit(0.5), F.lit(0.25), F.col("token_overlap"))
    return own.select(
        "a", "b", F.round("token_overlap", 6).alias("token_overlap"), "pincode_match",
        F.round("length_ratio", 6).alias("length_ratio"), F.round(blend, 6).alias("blend"),
    )


# --- evaluation ------------------------------------------------------------------------------------------------

SCORED = "s AS (SELECT least(1.0, n_chars / 10000.0) AS score, quality AS label FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL)"


def scored(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    return rows.where("quality IS NOT NULL").select(F.least(F.lit(1.0), F.col("n_chars") / 10000.0).alias("score"), F.col("quality").alias("label"))


@query(
    "calibration_metrics",
    f"""WITH {SCORED}, g AS (SELECT score, count(*) AS c, sum(label) AS p FROM s GROUP BY score),
r AS (SELECT sum(p * (coalesce(before, 0) + (c + 1) / 2.0)) AS rank_sum FROM (SELECT *, sum(c) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM g)),
t AS (SELECT count(*) AS n, sum(label) AS p, min(score) AS low, max(score) AS high, avg(score) AS mean, avg((score - label) * (score - label)) AS brier FROM s)
SELECT n AS rows, round(p / n, 6) AS positive_rate, round(low, 6) AS low, round(high, 6) AS high, round(mean, 6) AS mean, round(brier, 6) AS brier,
  round((rank_sum - p * (p + 1) / 2.0) / (p * (n - p)), 6) AS roc_auc, round(gained / p, 6) AS average_precision,
  round(p10, 6) AS p10, round(p50, 6) AS p50, round(p90, 6) AS p90 FROM t, r,
  (SELECT sum(g.p * (tp - coalesce(pb, 0)) / (tn - coalesce(nb, 0))) AS gained FROM (SELECT *, sum(c) OVER w AS nb, sum(p) OVER w AS pb,
     (SELECT sum(label) FROM s) AS tp, (SELECT count(*) FROM s) AS tn FROM g WINDOW w AS (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) g),
  (SELECT quantile_cont(score, 0.1) AS p10, quantile_cont(score, 0.5) AS p50, quantile_cont(score, 0.9) AS p90 FROM s)""",
)
def _(spark, sf):
    return evaluation.calibration(scored(spark, sf), "score", "label")


@query("isotonic_calibrate")
def _(spark, sf):
    rows = scored(spark, sf)
    model = ranking.fit_calibrator(rows, "score", "label")
    return ranking.calibrate(model, rows, "score").select("score", "label", F.round("calibrated", 9).alias("calibrated"))


# --- quality ---------------------------------------------------------------------------------------------------


@query(
    "keep_first",
    f"WITH r AS (SELECT doc_id, row_number() OVER (PARTITION BY {_norm('text')} ORDER BY doc_id) AS k FROM documents) SELECT doc_id FROM r WHERE k = 1",
)
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.md5(X.normalize_v1("text")).alias("k"))
    return quality.keep_first(docs, F.col("k"), "doc_id").select("doc_id")


@query(
    "duplicate_groups",
    "WITH g AS (SELECT count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1) SELECT count(*) AS groups, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS extra_rows FROM g",
)
def _(spark, sf):
    return quality.duplicate_groups(table(spark, sf, "documents"), F.md5("text"))


@query(
    "multi_state_pins",
    f"WITH {ADDRESS_SQL} SELECT pin, count(DISTINCT city) AS values FROM addr GROUP BY pin HAVING count(DISTINCT city) > 1",
)
def _(spark, sf):
    return quality.spread_keys(addresses(spark, sf), "pin", "city")


@query(
    "issue_counts",
    f"""WITH {ADDRESS_SQL} SELECT 'glued_number' AS issue, count(*) AS n FROM addr
WHERE regexp_matches(replace(replace(text, 'No ', 'no'), ' road', 'road'), '\\b[0-9]+[a-z]{{3,}}') HAVING count(*) > 0
UNION ALL SELECT 'comma_no_space', count(*) FROM addr HAVING count(*) > 0""",
)
def _(spark, sf):
    glued = F.replace(F.replace("text", F.lit("No "), F.lit("no")), F.lit(" road"), F.lit("road"))
    rows = addresses(spark, sf).select(F.replace(glued, F.lit(", "), F.lit(",")).alias("text"))
    return quality.issue_counts(rows, "text")


@query(
    "quality_report",
    """SELECT lang, count(*) AS rows, count(DISTINCT text) AS distinct_texts, CAST(sum(CASE WHEN length(trim(coalesce(text, ''))) < 20 THEN 1 ELSE 0 END) AS BIGINT) AS short_rows,
  CAST(sum(CASE WHEN trim(coalesce(text, '')) = '' THEN 1 ELSE 0 END) AS BIGINT) AS blank_rows FROM documents GROUP BY lang""",
)
def _(spark, sf):
    return quality.quality_report(table(spark, sf, "documents"), "text", "lang")


REPEATED = "t AS (SELECT addr_id, string_split(concat(street, ' ', street, ' road ', street, ' ', city, ' ', city), ' ') AS w FROM addr)"


@query(
    "run_dedupe",
    f"WITH {ADDRESS_SQL}, {REPEATED} SELECT addr_id, array_to_string(list_filter(w, lambda x, i: i = 1 OR x <> w[i - 1]), ' ') AS kept FROM t",
)
def _(spark, sf):
    return addresses(spark, sf).select("addr_id", F.array_join(X.drop_runs(repeated()), " ").alias("kept"))


def repeated():
    return F.split(F.concat_ws(" ", "street", "street", F.lit("road"), "street", "city", "city"), " ")


@query(
    "cap_repeats",
    f"WITH {ADDRESS_SQL}, {REPEATED} SELECT addr_id, array_to_string(list_filter(w, lambda x, i: len(list_filter(w, lambda y: y = x)) < 3 "
    "OR len(list_filter(w[1:i - 1], lambda y: y = x)) < 2), ' ') AS kept FROM t",
)
def _(spark, sf):
    return addresses(spark, sf).select("addr_id", F.array_join(X.cap_repeats(repeated()), " ").alias("kept"))


@query("noise_injection")
def _(spark, sf):
    return quality.add_noise(addresses(spark, sf), "addr_id", "text").select("addr_id", "copy", "noisy")


@query("clean_training")
def _(spark, sf):
    rows = noisy_addresses(spark, sf).select(
        F.col("addr_id").alias("id"), F.col("text").alias("raw_address"), F.col("noisy").alias("clean_target"),
        F.col("pin").alias("pincode"), (F.col("addr_id") % 2 == 0).alias("is_verified"),
    )
    return quality.clean_training(rows, "id").select("id", "cleaned", "target_source")


# --- tables ----------------------------------------------------------------------------------------------------


@query(
    "structured_lookup",
    "SELECT o_orderkey, c_name, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey",
)
def _(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    known = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return orders.join(known, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "c_name", "c_mktsegment")


@query(
    "pincode_dimension",
    f"WITH {ADDRESS_SQL}, r AS (SELECT pin, text, city, street, row_number() OVER (PARTITION BY pin ORDER BY text) AS k FROM addr) "
    "SELECT pin AS pincode, text AS office, city AS district, street AS state FROM r WHERE k = 1",
)
def _(spark, sf):
    rows = addresses(spark, sf).select(
        F.col("pin").alias("Pin Code"), F.col("text").alias("OfficeName"), F.col("city").alias("DistrictName"), F.col("street").alias("State")
    )
    return readers.pincode_dimension(rows)


@query(
    "anti_insert",
    """WITH n AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders)
SELECT o_custkey, o_orderkey FROM n WHERE k = 1 AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""",
)
def _(spark, sf):
    known = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    new = table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    return tables.insert_new(known, new, ["o_custkey"], "o_orderkey")


@query(
    "semi_bucket",
    f"WITH {ADDRESS_SQL} SELECT addr_id FROM addr WHERE pin IN (SELECT pin FROM addr WHERE addr_id % 100 = 0)",
)
def _(spark, sf):
    rows = addresses(spark, sf)
    return rows.join(asked(rows, "addr_id").select("pin").distinct(), "pin", "left_semi").select("addr_id")


@query(
    "upsert_merge",
    """WITH a AS (SELECT c_custkey AS k, c_mktsegment AS payload FROM customer), b AS (SELECT o_custkey AS k, max(CASE WHEN o_orderpriority LIKE '%HIGH' THEN o_orderpriority END) AS payload FROM orders GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, coalesce(b.payload, a.payload) AS payload FROM a FULL JOIN b ON a.k = b.k""",
)
def _(spark, sf):
    stored = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("payload"))
    high = F.when(F.col("o_orderpriority").like("%HIGH"), F.col("o_orderpriority"))
    new = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max(high).alias("payload"))
    return tables.upsert(stored, new, "k", "payload")


@query(
    "changed_rows",
    f"WITH {ADDRESS_SQL}, {NOISY_SQL} SELECT addr_id, text AS before, noisy AS after FROM noisy WHERE text <> noisy",
)
def _(spark, sf):
    rows = noisy_addresses(spark, sf)
    return tables.changed_rows(rows.select("addr_id", "text"), rows.select("addr_id", F.col("noisy").alias("text")), "addr_id", "text")


# --- usage -----------------------------------------------------------------------------------------------------


def events(spark, sf):
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query(
    "feedback_daily",
    """WITH l AS (SELECT max(CAST(ts AS DATE)) AS d FROM events), c AS (SELECT CAST(unnest(generate_series(d - 13, d, INTERVAL 1 DAY)) AS DATE) AS day FROM l),
p AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1) SELECT CAST(c.day AS VARCHAR) AS day, coalesce(n, 0) AS n FROM c LEFT JOIN p ON c.day = p.day""",
)
def _(spark, sf):
    return evaluation.daily_counts(events(spark, sf))


@query("status_histogram", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def _(spark, sf):
    return events(spark, sf).groupBy("event_type").agg(F.count("*").alias("n"))


@query(
    "top_users",
    "WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1) SELECT user_id, n FROM c ORDER BY n DESC, user_id LIMIT 8",
)
def _(spark, sf):
    return events(spark, sf).groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "user_id").limit(8)


@query(
    "dashboard",
    """SELECT count(*) AS total, CAST(sum(CASE WHEN ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR THEN 1 ELSE 0 END) AS BIGINT) AS last_day,
  round(avg(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END), 6) AS purchase_share, round(avg(value), 4) AS mean_value FROM events""",
)
def _(spark, sf):
    rows = events(spark, sf)
    last = rows.agg(F.max("ts").alias("last"))
    joined = rows.crossJoin(F.broadcast(last))  # one row
    return joined.agg(
        F.count("*").alias("total"),
        F.sum(F.when(F.col("ts") >= F.col("last") - F.expr("INTERVAL 24 HOURS"), 1).otherwise(0)).alias("last_day"),
        F.round(F.avg(F.when(F.col("event_type") == "purchase", 1.0).otherwise(0.0)), 6).alias("purchase_share"),
        F.round(F.avg("value"), 4).alias("mean_value"),
    )


@query(
    "quota_daily",
    "SELECT event_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) <= 3 AS allowed FROM events",
)
def _(spark, sf):
    return feedback.within_quota(events(spark, sf), "user_id", 3).select("event_id", "allowed")


@query(
    "latest_per_key",
    "WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) SELECT user_id, event_id FROM r WHERE k = 1",
)
def _(spark, sf):
    return evaluation.latest_per_key(events(spark, sf), "user_id", "ts", "event_id").select("user_id", "event_id")


@query(
    "bandit_values",
    "SELECT event_type AS arm, count(*) AS pulls, round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END), 6) AS value FROM events GROUP BY 1",
)
def _(spark, sf):
    rows = events(spark, sf).select(F.col("event_type").alias("arm"), F.when(F.col("value") > 50, 1.0).otherwise(0.0).alias("reward"))
    return evaluation.bandit_values(rows, "arm", "reward")


@query("json_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(spark, sf):
    return events(spark, sf).select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query(
    "stream_feedback_window",
    "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
)
def _(spark, sf):
    stream = feedback.windowed_counts(feedback.read_event_stream(spark, f"{sf}/events.parquet"))
    top = f"{shared_dir(spark)}/feedback-{uuid.uuid4().hex}"
    done = feedback.run_to_table(stream, f"{top}/table", f"{top}/checkpoint", ["day", "event_type"])
    return done.select(F.to_date("day").cast("string").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query("page_addresses")
def _(spark, sf):
    pages = table(spark, sf, "pages")
    plain = X.squeeze(F.regexp_replace(F.regexp_replace("html", "(?s)<(script|style)[^>]*>.*?</\\1>", " "), "<[^>]+>", " "))
    return pages.select("page_id", X.strip_plus_code(plain).alias("text"), X.detect_pincode(plain).alias("pincode"))


from . import corrections  # noqa: E402, F401  registers its queries
