"""Queries of display forms, spelling in context, verification, candidate merging and whole corrections, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import display as D
from ..functions import text as X
from ..functions import vocabulary as V
from ..operators import blocking, correction, evaluation, lexicon, matching, quality, ranking, retrieval, spelling, tables, verification
from ..sources import readers
from ..sources.writers import staged
from ..streaming import feedback
from .catalogue import _in, _norm, _toks, asked, events, query, vocabulary_and_words
from .corpus import ADDRESS_SQL, CITIES, NOISY_SQL, addresses, noisy_addresses, table

ASKED = "q AS (SELECT addr_id AS query_id, * FROM addr WHERE addr_id % 100 = 0)"


def asks_of(rows, *cols):
    return asked(rows, "addr_id").select(F.col("addr_id").alias("query_id"), *cols)


BLOCKING_NORM = "trim(regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def _cap(x: str) -> str:
    return f"upper(substr({x}, 1, 1)) || substr({x}, 2)"


# --- display ---------------------------------------------------------------------------------------------------


@query(
    "display_address",
    f"""WITH {ADDRESS_SQL}, t AS (SELECT addr_id, {_toks(_norm('text'))} AS toks FROM addr)
SELECT addr_id, concat(addr_id % 50, '/', addr_id % 7, ' ', array_to_string(list_transform(toks, lambda t, i: CASE WHEN t = 'no' AND regexp_full_match(toks[i + 1], '[0-9]+') THEN 'No.'
  ELSE {_cap('t')} END), ' '), ' ', addr_id % 9, '/', addr_id % 8, 'B MG') AS shown FROM t""",
)
def _(spark, sf):
    k = F.col("addr_id")
    part = lambda *x: F.concat(*[v.cast("string") for v in x])
    tail = part(F.lit(" "), k % 9, F.lit(" "), k % 8, F.lit(" b mg"))
    text = F.concat(part(k % 50, F.lit("/"), k % 7, F.lit(" ")), "text", tail)
    # The pincode before the tail would make a pair with its first number, so a word stands between.
    text = F.regexp_replace(text, r"([0-9]{6}) ", "$1 zz ")
    return addresses(spark, sf).select("addr_id", F.replace(D.display(text), F.lit(" Zz"), F.lit("")).alias("shown"))


@query(
    "comma_display",
    f"""WITH {ADDRESS_SQL} SELECT addr_id, concat('No. ', addr_id % 977, '/', addr_id % 50, ', ', CASE street WHEN 'building' THEN 'Building, Road' ELSE concat({_cap('street')}, ' Road') END, ', Pune, Tamil Nadu ', pin, ', India') AS shown FROM addr""",
)
def _(spark, sf):
    k = F.col("addr_id")
    text = F.concat(F.lit("no "), (k % 977).cast("string"), F.lit(" "), (k % 50).cast("string"), F.lit(" "), "street", F.lit(" road pune tamil nadu india "), "pin")
    return addresses(spark, sf).select("addr_id", D.comma_display(text).alias("shown"))


@query(
    "slash_restore",
    f"WITH {ADDRESS_SQL} SELECT addr_id, concat('no ', addr_id % 977, '/', addr_id % 50, ' ', street) AS restored FROM addr",
)
def _(spark, sf):
    k = F.col("addr_id")
    a, b = (k % 977).cast("string"), (k % 50).cast("string")
    raw, split = F.concat(F.lit("No "), a, F.lit("/"), b, F.lit(" "), "street"), F.concat(F.lit("no "), a, F.lit(" "), b, F.lit(" "), "street")
    return addresses(spark, sf).select("addr_id", D.restore_slashes(raw, split).alias("restored"))


@query(
    "merge_nouns",
    f"""WITH {ADDRESS_SQL} SELECT addr_id, trim(concat('a road ', array_to_string(list_sort(list_distinct(list_filter({_toks(_norm('text'))},
  lambda t: regexp_full_match(t, '[a-z]{{4,}}') AND t NOT IN {_in((*V.CITIES, *V.ROAD_WORDS, *V.LOCALITY_WORDS, *V.STOP_WORDS))}))), ' '))) AS merged FROM addr""",
)
def _(spark, sf):
    return addresses(spark, sf).select("addr_id", D.merge_dropped(F.col("text"), F.lit("a road")).alias("merged"))


@query(
    "house_number_replace",
    f"""WITH {ADDRESS_SQL} SELECT addr_id, CASE WHEN addr_id % 3 = 0 THEN street WHEN addr_id % 3 = 1 THEN concat('7/A, ', street) ELSE concat('7/A ', street) END AS written FROM addr""",
)
def _(spark, sf):
    k = F.col("addr_id")
    text = F.when(k % 3 == 2, F.concat((k % 900 + 1).cast("string"), F.lit("/2 "), "street")).otherwise(F.col("street"))
    return addresses(spark, sf).select("addr_id", D.replace_house_number(text, F.when(k % 3 != 0, F.lit("7/A"))).alias("written"))


@query(
    "house_numbers_only",
    f"""WITH {ADDRESS_SQL}, n AS (SELECT addr_id, pin, list_filter({_toks(_norm('text'))}, lambda t: regexp_full_match(t, '[0-9]+') AND length(t) <> 6) AS nums FROM addr)
SELECT addr_id, array_to_string(list_filter(nums, lambda t: NOT (length(t) <= 3 AND t IN (right(pin, 2), right(pin, 3), right(pin, 4)))), ' ') AS numbers FROM n""",
)
def _(spark, sf):
    numbers = X.number_tokens(X.tokens(X.normalize_v1("text")))
    return addresses(spark, sf).select("addr_id", F.array_join(D.real_house_numbers(numbers, F.col("pin")), " ").alias("numbers"))


@query(
    "rewrite_accepted",
    f"""WITH {ADDRESS_SQL}, {NOISY_SQL}, t AS (SELECT addr_id, list_distinct(list_filter({_toks(_norm('noisy'))}, lambda t: regexp_full_match(t, '[a-z]{{5,}}'))) AS own, {_toks(_norm('text'))} AS new FROM noisy)
SELECT addr_id, addr_id % 4 IN (0, 3) AND (len(own) = 0 OR len(list_intersect(own, new)) >= 0.45 * len(own)) AS accepted FROM t""",
)
def _(spark, sf):
    k = F.col("addr_id")
    rewrite = F.when(k % 4 == 1, F.concat("text", F.lit(" 98765"))).when(k % 4 == 2, F.concat(F.lit("see www.x.in "), "text")).otherwise(F.col("text"))
    return noisy_addresses(spark, sf).select("addr_id", D.usable_rewrite(rewrite, F.col("noisy")).alias("accepted"))


@query(
    "model_prompts",
    f"""WITH {ADDRESS_SQL} SELECT addr_id, concat(text, CASE WHEN addr_id % 3 = 0 THEN concat(' | city=', city, '; pincode=', pin) WHEN addr_id % 3 = 1 THEN concat(' | pincode=', pin) ELSE '' END) AS prompt FROM addr""",
)
def _(spark, sf):
    k, none = F.col("addr_id"), F.lit(None).cast("string")
    return addresses(spark, sf).select(
        "addr_id", D.geo_prompt(F.col("text"), F.when(k % 3 == 0, F.col("city")), none, F.when(k % 3 != 2, F.col("pin"))).alias("prompt")
    )


@query(
    "history_filter",
    f"""WITH {ADDRESS_SQL} SELECT addr_id, CASE WHEN addr_id % 100 >= 70 THEN 'ok' WHEN addr_id % 100 >= 40 THEN 'warn' ELSE 'bad' END AS bucket FROM addr WHERE contains(lower(concat_ws(' ', text, city)), 'building')""",
)
def _(spark, sf):
    rows = addresses(spark, sf).where(D.history_match(F.lit("Building"), ["text", "city"]))
    return rows.select("addr_id", D.history_bucket(F.col("addr_id") % 100).alias("bucket"))


@query(
    "relative_times",
    """SELECT o_orderkey, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN concat(s // 60, 'm ago') WHEN s < 86400 THEN concat(s // 3600, 'h ago') ELSE concat(s // 86400, 'd ago') END AS ago
FROM (SELECT o_orderkey, (o_orderkey * 37) % 1000000 AS s FROM orders)""",
)
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", D.relative_time((F.col("o_orderkey") * 37) % 1000000).alias("ago"))


@query(
    "bad_labels",
    """SELECT c_custkey, c_custkey % 3 = 0 OR c_custkey % 3 = 1 AS bad, concat(CASE WHEN c_custkey % 3 = 0 THEN 'road' WHEN c_custkey % 3 = 1 THEN '2nd floor' ELSE 'flour mill' END, ' ', c_custkey) AS repaired FROM customer""",
)
def _(spark, sf):
    k = F.col("c_custkey")
    label = F.concat(F.when(k % 3 == 0, "raod").when(k % 3 == 1, "2nd flour").otherwise("flour mill"), F.lit(" "), k.cast("string"))
    return table(spark, sf, "customer").select("c_custkey", D.bad_label(label).alias("bad"), D.repair_label(label).alias("repaired"))


@query(
    "fix_rows",
    f"WITH {ADDRESS_SQL} SELECT addr_id, concat(street, ' road ', addr_id % 90 + 10, ' layout, ', 'pune 411001') AS fixed FROM addr",
)
def _(spark, sf):
    number = (F.col("addr_id") % 90 + 10).cast("string")
    text = F.concat("street", F.lit(" road road "), number, F.lit("layout,pune 411001"))
    return addresses(spark, sf).select("addr_id", D.fix_address(text).alias("fixed"))


# --- normalising and parsing, further --------------------------------------------------------------------------


@query(
    "normalize_blocking",
    f"WITH {ADDRESS_SQL} SELECT addr_id, trim(regexp_replace(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS normalized FROM addr",
)
def _(spark, sf):
    return addresses(spark, sf).select("addr_id", X.normalize_blocking("text").alias("normalized"))


@query(
    "expand_tokens",
    f"""WITH {ADDRESS_SQL} SELECT addr_id, concat(CASE addr_id % 3 WHEN 0 THEN 'bangalore' WHEN 1 THEN 'road' ELSE '12/4' END, ' ', street, ' street') AS expanded FROM addr""",
)
def _(spark, sf):
    k = F.col("addr_id")
    first = F.when(k % 3 == 0, "blr").when(k % 3 == 1, "rd").otherwise("12/4")
    toks = X.expand_tokens(F.split(F.concat(first, F.lit(" "), "street", F.lit(" st/")), " "))
    return addresses(spark, sf).select("addr_id", F.array_join(toks, " ").alias("expanded"))


@query(
    "sub_anchors",
    f"WITH {ADDRESS_SQL} SELECT addr_id, CAST(addr_id % 9 + 1 AS VARCHAR) AS block, CAST(addr_id % 5 + 1 AS VARCHAR) AS cross_number FROM addr",
)
def _(spark, sf):
    k = F.col("addr_id")
    text = F.concat((k % 9 + 1).cast("string"), F.lit("th block "), "street", F.lit(" "), (k % 5 + 1).cast("string"), F.lit(" cross 8 cross"))
    found = addresses(spark, sf).select("addr_id", X.sub_anchors(F.split(text, " ")).alias("m"))
    return found.select("addr_id", F.col("m")["block"].alias("block"), F.col("m")["cross"].alias("cross_number"))


@query(
    "compose_parts",
    f"WITH {ADDRESS_SQL} SELECT addr_id, concat_ws(' ', nullif(trim(CASE WHEN addr_id % 2 = 0 THEN ' ' ELSE street END), ''), city, pin) AS composed FROM addr",
)
def _(spark, sf):
    rows = addresses(spark, sf).withColumn("street", F.when(F.col("addr_id") % 2 == 0, " ").otherwise(F.col("street")))
    rows = rows.withColumnRenamed("city", "town").withColumnRenamed("pin", "pincode")
    return rows.select("addr_id", X.compose(("street", "town", "pincode")).alias("composed"))


@query(
    "append_missing",
    f"WITH {ADDRESS_SQL} SELECT addr_id, concat({_cap('street')}, ', Pune', ', ', pin) AS whole FROM addr",
)
def _(spark, sf):
    whole = X.append_missing(F.col("street"), [F.lit("pune"), F.lit(None).cast("string"), F.col("pin"), F.col("street")])
    return addresses(spark, sf).select("addr_id", whole.alias("whole"))


@query(
    "percent_shown",
    "SELECT o_orderkey, CAST(greatest(0, least(100, round(CASE WHEN v <= 1 THEN v * 100 ELSE v END))) AS INT) AS pct FROM (SELECT o_orderkey, (o_orderkey % 240) / 2.0 AS v FROM orders)",
)
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", X.percent((F.col("o_orderkey") % 240) / 2.0).alias("pct"))


@query(
    "blocking_terms",
    f"""WITH {ADDRESS_SQL}, t AS (SELECT addr_id, {_toks(BLOCKING_NORM)} AS w FROM addr)
SELECT addr_id, array_to_string(list_filter(w, lambda t, i: regexp_full_match(t, '[0-9]+') AND list_position(w, t) = i)[1:2], ' ') AS numbers,
  array_to_string(list_filter(w, lambda t, i: length(t) >= 4 AND NOT regexp_full_match(t, '[0-9]+') AND t NOT IN {_in((*CITIES, *V.STOP_WORDS))} AND list_position(w, t) = i)[1:6], ' ') AS words FROM t""",
)
def _(spark, sf):
    found = addresses(spark, sf).select("addr_id", blocking.blocking_terms("text", CITIES).alias("b"))
    return found.select("addr_id", F.array_join("b.numbers", " ").alias("numbers"), F.array_join("b.words", " ").alias("words"))


@query(
    "geo_anchors",
    f"WITH {ADDRESS_SQL} SELECT addr_id, list_filter({_toks(_norm('text'))}, lambda t: t IN {_in(CITIES)})[-1] AS city, pin AS pincode FROM addr",
)
def _(spark, sf):
    found = addresses(spark, sf).select("addr_id", blocking.geo_anchors("text", CITIES).alias("g"))
    return found.select("addr_id", "g.city", "g.pincode")


@query(
    "building_gate",
    f"WITH {ADDRESS_SQL} SELECT addr_id, addr_id % 3 <> 0 AS allowed FROM addr",
)
def _(spark, sf):
    k = F.col("addr_id")
    asks = F.when(k % 3 == 0, "gravity tower pune").when(k % 3 == 1, "royal tower pune").otherwise("machinery tower")
    return addresses(spark, sf).select("addr_id", matching.building_gate(asks, F.lit("No 1 Machinery Road")).alias("allowed"))


@query(
    "field_flags",
    f"""WITH {ADDRESS_SQL}, v AS (SELECT addr_id, CASE addr_id % 5 WHEN 0 THEN text WHEN 1 THEN 'pune' WHEN 2 THEN '12 mg road pune 5600' WHEN 3 THEN '12 mg road pune 560001' ELSE 'x y z' END AS s FROM addr),
t AS (SELECT addr_id, {_toks(_norm('s'))} AS w FROM v)
SELECT addr_id, concat_ws(',', CASE WHEN len(list_filter(w, lambda t: regexp_matches(t, '[0-9]'))) = 0 THEN 'no number' END,
  CASE WHEN len(list_filter(w, lambda t: t IN {_in(V.ROAD_WORDS)})) = 0 THEN 'no street' END, CASE WHEN len(list_filter(w, lambda t: t IN {_in(V.CITIES)})) = 0 THEN 'no city' END,
  CASE WHEN len(list_filter(w, lambda t: regexp_full_match(t, '[0-9]{{6}}'))) > 0 THEN NULL WHEN len(list_filter(w, lambda t: regexp_full_match(t, '[0-9]{{4,5}}'))) > 0 THEN 'partial pincode' ELSE 'no pincode' END,
  CASE WHEN len(w) < 3 THEN 'too short' END) AS warnings FROM t""",
)
def _(spark, sf):
    k = F.col("addr_id") % 5
    s = F.when(k == 0, F.col("text")).when(k == 1, "pune").when(k == 2, "12 mg road pune 5600").when(k == 3, "12 mg road pune 560001").otherwise("x y z")
    return addresses(spark, sf).select("addr_id", F.array_join(X.field_warnings(s), ",").alias("warnings"))


# --- spelling in context ---------------------------------------------------------------------------------------


@query(
    "safe_corrections",
    f"""WITH {ADDRESS_SQL}, {NOISY_SQL}, p AS (SELECT DISTINCT substr(street, 1, 1 + CAST(addr_id % length(street) AS INT)) AS a, street AS b FROM noisy)
SELECT a, b, abs(length(a) - length(b)) <= 3 AND (substr(a, 1, 1) = substr(b, 1, 1) OR regexp_replace(a, '[aeiou]', '', 'g') = regexp_replace(b, '[aeiou]', '', 'g') OR (length(a) >= 6 AND levenshtein(a, b) <= 1)) AS safe FROM p""",
)
def _(spark, sf):
    size = (F.col("addr_id") % F.char_length("street") + 1).cast("int")
    pairs = addresses(spark, sf).select(F.substr("street", F.lit(1), size).alias("a"), F.col("street").alias("b")).distinct()
    return pairs.select("a", "b", spelling.is_safe(F.col("a"), F.col("b")).alias("safe"))


@query(
    "bigram_scores",
    f"""WITH {ADDRESS_SQL}, t AS (SELECT addr_id, {_toks(_norm('text'))} AS w FROM addr),
u AS (SELECT unnest(w) AS a FROM t), g AS (SELECT a, count(*) AS c FROM u GROUP BY a), v AS (SELECT count(*) AS size FROM g),
p AS (SELECT addr_id, unnest(list_transform(range(1, len(w)), lambda i: {{'a': w[i], 'b': w[i + 1]}})) AS p FROM t), b AS (SELECT p.a AS a, p.b AS b, count(*) AS n FROM p GROUP BY 1, 2)
SELECT addr_id, round(avg(ln((n + 1.0) / (c + size))), 6) AS score FROM p JOIN b ON p.a = b.a AND p.b = b.b JOIN g ON g.a = b.a, v GROUP BY addr_id""",
)
def _(spark, sf):
    rows = addresses(spark, sf).select("addr_id", X.tokens(X.normalize_v1("text")).alias("w"))
    size = rows.select(F.explode("w").alias("t")).agg(F.countDistinct("t")).first()[0]
    out = lexicon.log_probability(rows, "addr_id", "w", lexicon.bigrams(rows, "w"), size)
    return out.select("addr_id", F.round("log_probability", 6).alias("score"))


@query("correct_sentences")
def _(spark, sf):
    vocabulary, _ = vocabulary_and_words(spark, sf)
    names = vocabulary.join(addresses(spark, sf).select(F.col("city").alias("token")).distinct(), "token", "left_semi")
    rows = noisy_addresses(spark, sf).select("addr_id", F.col("noisy").alias("text"))
    out = spelling.correct_sentences(rows, "addr_id", "text", vocabulary, names)
    return out.select("addr_id", "corrected", F.size("changes").cast("long").alias("n_changes"))


@query(
    "aligned_changes",
    f"WITH {ADDRESS_SQL} SELECT addr_id, concat(street, '>', city) AS changes FROM addr WHERE street <> city",
)
def _(spark, sf):
    left, right = F.array(F.lit("no"), F.col("street"), F.lit("road")), F.array(F.lit("new"), F.lit("no"), F.col("city"), F.lit("road"))
    rows = addresses(spark, sf).where("street <> city").select("addr_id", spelling.aligned_changes(left, right).alias("c"))
    return rows.select("addr_id", F.array_join(F.transform("c", lambda x: F.concat_ws(">", x["src"], x["dst"])), ",").alias("changes"))


@query(
    "refine_by_trusted",
    f"WITH {ADDRESS_SQL} SELECT addr_id, concat('no 12 ', street, ' apartment koramangala ', pin) AS refined FROM addr",
)
def _(spark, sf):
    rows = addresses(spark, sf).select("addr_id", "street", "pin")
    noisy = F.concat(F.lit("no 12 "), "street", F.lit(" zpartment kora mangala "), "pin")
    trusted = F.concat(F.lit("12, "), "street", F.lit(" Apartment, Koramangala"))
    return rows.select("addr_id", spelling.refine(noisy, F.regexp_replace(trusted, "zz", "z")).alias("refined"))


# --- verification ----------------------------------------------------------------------------------------------

def dimension(spark, sf):
    """Pincodes of even last digit, with the smallest city as their state."""
    rows = addresses(spark, sf).where(F.col("pin").cast("int") % 2 == 0)
    return rows.groupBy(F.col("pin").alias("pincode")).agg(F.lit("x").alias("office"), F.min("street").alias("district"), F.min("city").alias("state"))


@query(
    "verify_addresses",
    f"""WITH {ADDRESS_SQL}, d AS (SELECT pin, min(city) AS st FROM addr WHERE CAST(pin AS INT) % 2 = 0 GROUP BY pin),
g AS (SELECT a.addr_id, addr_id % 3 <> 0 AS geo, CASE WHEN addr_id % 4 = 0 THEN 'elsewhere' ELSE 'state of ' || city END AS gs, d.pin IS NOT NULL AS known, d.st FROM addr a LEFT JOIN d ON a.pin = d.pin),
n AS (SELECT *, known AND geo AND NOT contains(gs, st) AS off FROM g)
SELECT addr_id, geo AS geocoded, known AS pincode_valid, NOT off AS consistent,
  concat_ws(',', CASE WHEN NOT geo THEN 'geocode_miss' END, CASE WHEN NOT known THEN 'pincode_unknown' END, CASE WHEN off THEN 'pincode_state_disagrees_with_geocode' END) AS notes FROM n""",
)
def _(spark, sf):
    k = F.col("addr_id")
    rows = addresses(spark, sf)
    state = F.when(k % 4 == 0, "Elsewhere").otherwise(F.concat(F.lit("State of "), "city"))
    payload = F.to_json(F.struct(F.concat("street", F.lit(" road")).alias("formatted"), state.alias("state"), F.col("pin").alias("postal_code")))
    answers = rows.where(k % 3 != 0).select(F.concat(F.lit("at "), k.cast("string")).alias("query"), payload.alias("payload"))
    given = rows.select("addr_id", F.concat(F.lit("At "), k.cast("string")).alias("text"), F.col("pin").alias("expected_pincode"), F.lit(None).cast("string").alias("expected_state"))
    out = verification.verify(readers.TableGeocoder(answers).geocode(given, "text"), dimension(spark, sf))
    return out.select("addr_id", "geocoded", "pincode_valid", "consistent", F.array_join("notes", ",").alias("notes"))


@query(
    "outside_trust",
    f"WITH {ADDRESS_SQL} SELECT addr_id, addr_id % 5 = 0 AS sure FROM addr",
)
def _(spark, sf):
    k = F.col("addr_id") % 5
    outside = (
        F.when(k == 0, F.concat(F.lit("26th Main, "), "street", F.lit(" quarter, Gravity Tower, Pune 560001")))
        .when(k == 1, F.concat(F.lit("16th Main, "), "street", F.lit(" quarter, Gravity Tower, Pune 560001")))
        .when(k == 2, F.concat(F.lit("26th Main, "), "street", F.lit(" quarter, Other Tower, Pune 560001")))
        .when(k == 3, F.concat(F.lit("26th Main, "), "street", F.lit(" quarter, Gravity Tower, Pune 560009")))
        .otherwise(F.lit("26th Main, Gravity"))
    )
    text = F.concat(F.lit("26 main "), "street", F.lit(" quarter gravity tower"))
    pin = F.when(k == 3, "560009").otherwise("560001")
    return addresses(spark, sf).select("addr_id", verification.trusted(text, outside, F.lit("560001"), F.lit(True), pin).alias("sure"))


@query("correct_addresses")
def _(spark, sf):
    rows = noisy_addresses(spark, sf)
    vocabulary, _ = vocabulary_and_words(spark, sf)
    names = vocabulary.join(rows.select(F.col("city").alias("token")).distinct(), "token", "left_semi")
    asks = rows.select(F.col("addr_id").alias("query_id"), F.col("noisy").alias("text"))
    out = correction.correct_addresses(asks, rows.select("addr_id", "text"), vocabulary, names, dimension(spark, sf), readers.NullGeocoder())
    return out.select("query_id", "status", "confidence", "address", "addr_id", "corrected", F.array_join("notes", ",").alias("notes"))


@query(
    "exact_lookup",
    f"""WITH {ADDRESS_SQL}, {NOISY_SQL}, c AS (SELECT {_norm('text')} AS norm, min(addr_id) AS addr_id FROM addr GROUP BY 1)
SELECT n.addr_id AS query_id, coalesce(x.addr_id, y.addr_id) AS addr_id, CASE WHEN x.addr_id IS NOT NULL THEN 0 ELSE 1 END AS "by" FROM noisy n
LEFT JOIN c x ON x.norm = {_norm('n.noisy')} LEFT JOIN c y ON y.norm = {_norm("CASE WHEN n.addr_id % 2 = 0 THEN n.text ELSE n.noisy END")} WHERE x.addr_id IS NOT NULL OR y.addr_id IS NOT NULL""",
)
def _(spark, sf):
    rows = noisy_addresses(spark, sf)
    asks = rows.select(F.col("addr_id").alias("query_id"), F.col("noisy").alias("raw"), F.when(F.col("addr_id") % 2 == 0, F.col("text")).otherwise(F.col("noisy")).alias("corrected"))
    return correction.exact_matches(asks, rows.select("addr_id", "text"))


@query(
    "fallback_tiers",
    """WITH q AS (SELECT c_custkey AS query_id FROM customer), a AS (SELECT o_custkey AS query_id, o_orderkey AS addr_id, (o_orderkey % 100) / 100.0 AS score, o_orderkey % 3 AS t FROM orders),
b AS (SELECT query_id, t, addr_id, score, row_number() OVER (PARTITION BY query_id, t ORDER BY score DESC, addr_id) AS k FROM a),
r AS (SELECT query_id, t, addr_id, score, row_number() OVER (PARTITION BY query_id ORDER BY t) AS k2 FROM b WHERE k = 1 AND score >= CASE t WHEN 0 THEN 0.92 WHEN 1 THEN 0.78 ELSE 0.6 END)
SELECT q.query_id, coalesce(CASE t WHEN 0 THEN 'verified' WHEN 1 THEN 'rerank' WHEN 2 THEN 'relaxed' END, 'generated') AS tier, r.addr_id, coalesce(score, 0.0) AS score FROM q LEFT JOIN r ON q.query_id = r.query_id AND k2 = 1""",
)
def _(spark, sf):
    asks = table(spark, sf, "customer").select(F.col("c_custkey").alias("query_id"))
    own = table(spark, sf, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("addr_id"), ((F.col("o_orderkey") % 100) / 100.0).alias("score"), (F.col("o_orderkey") % 3).alias("t"))
    tiers = [(name, own.where(F.col("t") == i).drop("t"), least) for i, (name, least) in enumerate((("verified", 0.92), ("rerank", 0.78), ("relaxed", 0.6)))]
    return correction.fall_through(asks, tiers)


@query(
    "retry_better",
    """SELECT o_orderkey AS query_id, CASE WHEN t THEN d ELSE c END AS confidence, CASE WHEN t THEN h ELSE g END AS geocoded, t AS retried
FROM (SELECT *, c < 0.75 AND (d > c OR (h AND NOT g)) AS t FROM (SELECT o_orderkey, (o_orderkey % 100) / 100.0 AS c, (o_orderkey % 70) / 70.0 AS d, o_orderkey % 2 = 0 AS g, o_orderkey % 3 = 0 AS h FROM orders))""",
)
def _(spark, sf):
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(k.alias("query_id"), k.alias("o_orderkey"))
    first = rows.select("query_id", ((k % 100) / 100.0).alias("confidence"), (k % 2 == 0).alias("geocoded"), F.lit("a").alias("address"))
    second = rows.select("query_id", ((k % 70) / 70.0).alias("confidence"), (k % 3 == 0).alias("geocoded"), F.lit("b").alias("address"))
    return correction.better_of(first, second).drop("address")


@query(
    "response_json",
    """SELECT o_orderkey AS query_id, concat('{"status":"', o_orderstatus, '","confidence":', o_orderkey % 10, '}') AS payload FROM orders""",
)
def _(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("query_id"), F.col("o_orderstatus").alias("status"), (F.col("o_orderkey") % 10).alias("confidence"))
    return correction.response(rows)


@query("live_suggest")
def _(spark, sf):
    rows = addresses(spark, sf)
    vocabulary, _ = vocabulary_and_words(spark, sf)
    asks = asks_of(rows, F.concat(F.substring("street", 1, 4)).alias("prefix"))
    return correction.live_suggest(asks, rows.select("addr_id", "text"), vocabulary)


# --- candidates ------------------------------------------------------------------------------------------------


@query(
    "full_cascade",
    f"""WITH {ADDRESS_SQL}, c AS (SELECT *, substr(city, 1, 2) AS state FROM addr), {ASKED.replace('addr WHERE', 'c WHERE')},
z AS (SELECT query_id, CASE WHEN query_id % 200 = 0 THEN NULL ELSE pin END AS pincode, CASE WHEN query_id % 300 = 0 THEN NULL ELSE city END AS city, CASE WHEN query_id % 400 = 0 THEN NULL ELSE state END AS state, CASE WHEN query_id % 700 = 0 THEN 'unknown' ELSE street END AS street FROM q),
m AS (SELECT query_id, addr_id, unnest([CASE WHEN c.pin = z.pincode AND c.city = z.city AND c.state = z.state AND c.street = z.street THEN 1 END, CASE WHEN c.city = z.city AND c.state = z.state AND c.street = z.street THEN 2 END,
  CASE WHEN c.city = z.city AND c.street = z.street THEN 3 END, CASE WHEN c.pin = z.pincode AND c.city = z.city AND c.state = z.state THEN 4 END, CASE WHEN c.city = z.city AND c.state = z.state THEN 5 END,
  CASE WHEN c.pin = z.pincode THEN 6 END, CASE WHEN c.city = z.city THEN 7 END]) AS tier FROM z JOIN c ON c.pin = z.pincode OR c.city = z.city),
b AS (SELECT query_id, min(tier) AS tier FROM m GROUP BY 1), r AS (SELECT m.*, row_number() OVER (PARTITION BY query_id ORDER BY addr_id) AS k FROM m JOIN b USING (query_id, tier))
SELECT query_id, tier, addr_id FROM r WHERE k <= 20""",
)
def _(spark, sf):
    none, k = F.lit(None).cast("string"), F.col("addr_id")
    rows = addresses(spark, sf).withColumn("state", F.substring("city", 1, 2)).withColumnRenamed("pin", "pincode")
    held = lambda n, c: F.when(k % n == 0, none).otherwise(F.col(c)).alias(c)
    asks = asks_of(rows, held(200, "pincode"), held(300, "city"), held(400, "state"), F.when(k % 700 == 0, "unknown").otherwise(F.col("street")).alias("street"))
    return blocking.full_cascade(asks, rows, top=20, keywords=False)


@query(
    "geo_then_keywords",
    f"""WITH {ADDRESS_SQL}, {ASKED}, g AS (SELECT q.query_id, a.addr_id FROM q JOIN addr a ON a.pin = q.pin AND a.city = q.city),
few AS (SELECT q.query_id, q.street FROM q LEFT JOIN g ON g.query_id = q.query_id GROUP BY 1, 2 HAVING count(g.addr_id) < 3),
w AS (SELECT few.query_id, a.addr_id, row_number() OVER (PARTITION BY few.query_id ORDER BY a.addr_id) AS k FROM few JOIN addr a ON a.street = few.street)
SELECT query_id, addr_id FROM g UNION SELECT query_id, addr_id FROM w WHERE k <= 50""",
)
def _(spark, sf):
    rows = addresses(spark, sf).withColumnRenamed("pin", "pincode")
    asks = asks_of(rows, "pincode", "city", F.array("street").alias("terms"))
    return blocking.geo_then_keywords(asks, rows.select("addr_id", "pincode", "city", F.col("street").alias("text")), least=3, top=50)


@query(
    "substring_filter",
    "SELECT c_custkey FROM customer WHERE contains(lower(c_name), '11') OR contains(lower(c_mktsegment), '11') OR contains(lower(c_name), 'build') OR contains(lower(c_mktsegment), 'build')",
)
def _(spark, sf):
    return table(spark, sf, "customer").where(blocking.substring_match(["c_name", "c_mktsegment"], ["11", "Build"])).select("c_custkey")


_SCORES = "a AS (SELECT o_custkey AS query_id, o_orderkey AS addr_id, (o_orderkey % 97) / 97.0 AS x, (o_orderkey % 89) / 89.0 AS y, (o_orderkey % 83) / 83.0 AS z FROM orders)"


def scores(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("query_id"), k.alias("addr_id"), ((k % 97) / 97.0).alias("x"), ((k % 89) / 89.0).alias("y"), ((k % 83) / 83.0).alias("z")
    )


def one_score(rows, c, where="1 = 1"):
    return rows.where(where).select("query_id", "addr_id", F.col(c).alias("score"))


@query(
    "weighted_fusion",
    f"""WITH {_SCORES}, m AS (SELECT *, max(x) OVER (PARTITION BY query_id) AS top FROM a)
SELECT query_id, addr_id, round(0.3 * x / (top + 1e-9) + 0.5 * y + CASE WHEN z > 0.55 THEN 0.2 * z ELSE 0 END, 6) AS score FROM m""",
)
def _(spark, sf):
    rows = scores(spark, sf)
    out = retrieval.weighted_fusion(one_score(rows, "x"), one_score(rows, "y"), one_score(rows, "z"), "addr_id")
    return out.select("query_id", "addr_id", F.round("score", 6).alias("score"))


@query(
    "union_sources",
    f"""WITH {_SCORES} SELECT query_id, addr_id, concat_ws('+', CASE WHEN x > 0.5 THEN 'bm25' END, CASE WHEN y > 0.5 THEN 'dense' END) AS sources FROM a WHERE x > 0.5 OR y > 0.5""",
)
def _(spark, sf):
    rows = scores(spark, sf)
    out = retrieval.union_distinct({"bm25": one_score(rows, "x", "x > 0.5"), "dense": one_score(rows, "y", "y > 0.5")}, "addr_id")
    return out.select("query_id", "addr_id", F.array_join("sources", "+").alias("sources"))


@query(
    "merge_best",
    f"""WITH {_SCORES}, m AS (SELECT query_id, addr_id, round(greatest(x, y), 6) AS score FROM a), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, addr_id) AS rank FROM m)
SELECT query_id, addr_id, score, rank FROM r WHERE rank <= 5""",
)
def _(spark, sf):
    rows = scores(spark, sf)
    return retrieval.merge_best(one_score(rows, "x"), one_score(rows, "y"), "addr_id", 5)


@query(
    "merge_live",
    f"""WITH {_SCORES} SELECT query_id, addr_id, CASE WHEN x > 0.4 THEN round(x, 6) END AS bm25, CASE WHEN y > 0.4 THEN round(y, 6) END AS live FROM a WHERE x > 0.4 OR y > 0.4""",
)
def _(spark, sf):
    rows = scores(spark, sf)
    static = rows.where("x > 0.4").select("query_id", "addr_id", F.create_map(F.lit("bm25"), "x").alias("scores"))
    out = retrieval.merge_live(static, one_score(rows, "y", "y > 0.4"), "addr_id")
    return out.select("query_id", "addr_id", F.round(F.col("scores")["bm25"], 6).alias("bm25"), F.round(F.col("scores")["sql"], 6).alias("live"))


@query(
    "top_by_strategy",
    f"""WITH {_SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY x DESC, addr_id) AS rx, row_number() OVER (PARTITION BY query_id ORDER BY y DESC, addr_id) AS ry FROM a)
SELECT query_id, addr_id FROM r WHERE rx <= 3 OR ry <= 2""",
)
def _(spark, sf):
    return retrieval.top_by_strategy(scores(spark, sf), {"x": 3, "y": 2}, "addr_id").select("query_id", "addr_id")


@query(
    "ordered_merge",
    f"""WITH {_SCORES}, s AS (SELECT query_id, 0 AS source, addr_id AS place, concat('Text ', addr_id % 7) AS text FROM a WHERE x > 0.5 UNION ALL SELECT query_id, 1, addr_id, concat('TEXT ', addr_id % 7) FROM a WHERE y > 0.5),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id, lower(text) ORDER BY source, place, text) AS k FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY source, place) AS p FROM o WHERE k = 1)
SELECT query_id, text, p AS place FROM r WHERE p <= 4""",
)
def _(spark, sf):
    rows = scores(spark, sf)
    one = lambda c, word: rows.where(f"{c} > 0.5").select("query_id", F.concat(F.lit(word), (F.col("addr_id") % 7).cast("string")).alias("text"), F.col("addr_id").alias("place"))
    return correction.ordered_merge([one("x", "Text "), one("y", "TEXT ")], k=4)


@query(
    "pincode_bucket",
    """WITH c AS (SELECT o_orderkey AS addr_id, CAST(o_orderkey % 50 AS VARCHAR) AS pincode FROM orders), q AS (SELECT c_custkey AS query_id, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE CAST(c_custkey % 60 AS VARCHAR) END AS pincode FROM customer),
s AS (SELECT o_custkey AS query_id, o_orderkey AS addr_id, (o_orderkey % 97) / 97.0 AS score FROM orders),
h AS (SELECT s.* FROM s JOIN q USING (query_id) JOIN c USING (addr_id) WHERE q.pincode = c.pincode),
f AS (SELECT pincode, addr_id, row_number() OVER (PARTITION BY pincode ORDER BY addr_id) AS k FROM c)
SELECT query_id, addr_id, round(score, 6) AS score FROM s WHERE query_id IN (SELECT query_id FROM q WHERE pincode IS NULL) UNION ALL SELECT query_id, addr_id, round(score, 6) FROM h
UNION ALL SELECT q.query_id, f.addr_id, 1.0 FROM q JOIN f ON q.pincode = f.pincode AND f.k <= 4 WHERE q.query_id NOT IN (SELECT query_id FROM h)""",
)
def _(spark, sf):
    corpus = table(spark, sf, "orders").select(F.col("o_orderkey").alias("addr_id"), (F.col("o_orderkey") % 50).cast("string").alias("pincode"))
    k = F.col("c_custkey")
    asks = table(spark, sf, "customer").select(k.alias("query_id"), F.when(k % 3 != 0, (k % 60).cast("string")).alias("pincode"))
    out = retrieval.pincode_bucket(one_score(scores(spark, sf), "x"), asks, corpus, "addr_id", seed=4)
    return out.select("query_id", "addr_id", F.round("score", 6).alias("score"))


@query("hybrid_search")
def _(spark, sf):
    toks = X.tokens(X.normalize_v1("text")).alias("toks")
    rows = staged(addresses(spark, sf).select("addr_id", "street", F.col("pin").alias("pincode"), toks), "rows")
    asks = asks_of(rows, "pincode", F.col("toks").alias("terms"))
    lexical = retrieval.bm25_top_k(asks, rows.select("addr_id", "toks"), 800, "addr_id")
    vector = lambda c: F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: (F.pmod(F.xxhash64(c, i), F.lit(200)) - 100) / 100.0)
    dense = retrieval.shared_top_k(asks_of(rows, vector("street").alias("vector")), rows.select("addr_id", vector("street").alias("embedding")), 800, "addr_id")
    out = retrieval.hybrid(lexical.drop("rank"), dense.drop("rank"), asks.select("query_id", "pincode"), rows.select("addr_id", "pincode"), "addr_id")
    return out.select("query_id", "addr_id", F.round("score", 5).alias("score"), "rank")


@query("keyword_retrieval")
def _(spark, sf):
    rows = addresses(spark, sf)
    asks = asks_of(rows, F.col("text"), F.array("street", "pin").alias("terms"))
    return retrieval.keyword_retrieval(asks, rows, ["text", "city"])


@query(
    "repick_ties",
    f"""WITH {_SCORES}, r AS (SELECT query_id, addr_id, x, y, z, row_number() OVER w AS place, x - lead(x) OVER w AS gap FROM a WINDOW w AS (PARTITION BY query_id ORDER BY x DESC, addr_id)),
c AS (SELECT *, max(CASE WHEN place = 1 AND gap < 0.02 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id) AS near FROM r),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN near = 1 AND place <= 5 THEN y * CASE WHEN z > 0 THEN z ELSE 0.05 END END DESC NULLS LAST, place) AS rank FROM c)
SELECT query_id, addr_id, rank FROM o""",
)
def _(spark, sf):
    rows = scores(spark, sf).withColumnsRenamed({"x": "probability", "y": "match_score", "z": "overlap"})
    return ranking.repick(rows).select("query_id", "addr_id", "rank")


@query("fuzzy_share")
def _(spark, sf):
    rows = noisy_addresses(spark, sf).select("addr_id", X.tokens(X.normalize_v1("noisy")).alias("a"), X.tokens(X.normalize_v1("text")).alias("b"))
    return matching.fuzzy_share(rows, ["addr_id"], "a", "b")


# --- quality, usage, tables ------------------------------------------------------------------------------------


@query(
    "issue_samples",
    f"WITH {ADDRESS_SQL} SELECT 'comma_no_space' AS issue, count(*) AS n, count(*) > 0 AS sampled FROM addr HAVING count(*) > 0",
)
def _(spark, sf):
    rows = addresses(spark, sf).select("addr_id", F.concat("street", F.lit(" avenue,india")).alias("text"))
    return quality.issue_samples(rows, "addr_id", "text").select("issue", "n", F.size("samples").between(1, 3).alias("sampled"))


@query(
    "cleaning_outcomes",
    f"""WITH {ADDRESS_SQL}, {NOISY_SQL} SELECT CASE WHEN addr_id % 4 = 0 THEN 'missing' WHEN addr_id % 4 = 1 THEN 'short' WHEN addr_id % 4 = 2 THEN 'bad_label' WHEN text = noisy THEN 'unchanged' ELSE 'changed' END AS outcome, count(*) AS n FROM noisy GROUP BY 1""",
)
def _(spark, sf):
    k = F.col("addr_id") % 4
    rows = noisy_addresses(spark, sf).select(F.when(k != 0, F.col("noisy")).alias("raw"), F.when(k == 1, "x").when(k == 2, "mg raod pune").otherwise(F.col("text")).alias("cleaned"))
    return quality.reject_reasons(rows, "raw", "cleaned")


@query(
    "top_changes",
    """WITH c AS (SELECT o_orderpriority AS src, o_orderstatus AS dst, count(*) AS n FROM orders GROUP BY 1, 2) SELECT src, dst, n FROM c ORDER BY n DESC, src, dst LIMIT 5""",
)
def _(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("src"), F.col("o_orderstatus").alias("dst"))
    return quality.top_changes(rows, 5)


@query(
    "backfill_pincode",
    f"WITH {ADDRESS_SQL} SELECT addr_id, pin AS pincode FROM addr WHERE addr_id % 2 = 0",
)
def _(spark, sf):
    rows = addresses(spark, sf).withColumn("pincode", F.when(F.col("addr_id") % 2 == 0, " ").otherwise(F.col("pin")))
    return quality.backfill_pincode(rows, "pincode", ["street", "text"]).select("addr_id", "pincode")


@query(
    "batch_stats",
    "SELECT count(*) AS rows, count(*) FILTER (o_orderstatus <> 'F') AS ok, count(*) FILTER (o_orderstatus = 'F') AS failed, round(avg(CASE WHEN o_orderstatus <> 'F' THEN (o_orderkey % 100) / 100.0 END), 6) AS mean_confidence FROM orders",
)
def _(spark, sf):
    status = F.when(F.col("o_orderstatus") == "F", "error").otherwise("ok")
    rows = table(spark, sf, "orders").select(status.alias("status"), ((F.col("o_orderkey") % 100) / 100.0).alias("confidence"))
    return evaluation.batch_stats(rows, "status", "confidence")


@query(
    "engine_stats",
    f"""WITH {ADDRESS_SQL} SELECT (SELECT count(*) FROM addr) AS addresses, (SELECT count(DISTINCT text) FROM addr) AS unique_addresses,
  (SELECT count(DISTINCT t) FROM (SELECT unnest({_toks(_norm('text'))}) AS t FROM addr)) AS vocabulary, (SELECT count(DISTINCT city) FROM addr) AS areas""",
)
def _(spark, sf):
    rows = addresses(spark, sf).withColumn("toks", X.tokens(X.normalize_v1("text")))
    return evaluation.engine_stats(rows, "text", "toks", rows.select("city").distinct())


@query(
    "merge_maps",
    "WITH a AS (SELECT c_custkey AS k, c_mktsegment AS v FROM customer WHERE c_custkey % 2 = 0), b AS (SELECT c_custkey AS k, c_name AS v FROM customer WHERE c_custkey % 3 = 0) SELECT coalesce(a.k, b.k) AS k, coalesce(b.v, a.v) AS v FROM a FULL JOIN b ON a.k = b.k",
)
def _(spark, sf):
    rows, k = table(spark, sf, "customer"), F.col("c_custkey")
    weak = rows.where(k % 2 == 0).select(k.alias("k"), F.col("c_mktsegment").alias("v"))
    return tables.merge_maps(weak, rows.where(k % 3 == 0).select(k.alias("k"), F.col("c_name").alias("v")), "k", "v")


@query(
    "still_to_do",
    "SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)",
)
def _(spark, sf):
    done = table(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("o_custkey"))
    return tables.still_to_do(table(spark, sf, "orders"), done, "o_custkey")


@query(
    "bandit_choice",
    """WITH v AS (SELECT event_type AS arm, round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END), 6) AS value FROM events GROUP BY 1),
l AS (SELECT list(arm ORDER BY arm) AS arms, first(arm ORDER BY value DESC, arm) AS best FROM v),
e AS (SELECT event_id, (event_id % 1000) / 1000.0 AS luck, greatest(0.02, 0.1 * pow(0.995, event_id)) AS share FROM events)
SELECT event_id, CASE WHEN luck < share THEN arms[least(CAST(floor(luck / share * len(arms)) AS INT) + 1, len(arms))] ELSE best END AS arm FROM e, l""",
)
def _(spark, sf):
    rows = events(spark, sf)
    values = evaluation.bandit_values(rows.select(F.col("event_type").alias("arm"), F.when(F.col("value") > 50, 1.0).otherwise(0.0).alias("reward")), "arm", "reward")
    return rows.select("event_id", feedback.choose_arm(values, (F.col("event_id") % 1000) / 1000.0, F.col("event_id")).alias("arm"))


@query(
    "precision_classes",
    "SELECT o_orderkey, CASE WHEN k >= 30 THEN 'ROOFTOP' WHEN k >= 26 THEN 'RANGE_INTERPOLATED' WHEN k >= 20 THEN 'GEOMETRIC_CENTER' ELSE 'APPROXIMATE' END AS kind FROM (SELECT o_orderkey, o_orderkey % 32 AS k FROM orders)",
)
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", readers.precision_class(F.col("o_orderkey") % 32, readers.PLACE_RANKS).alias("kind"))


@query(
    "geo_vocabulary",
    f"""WITH {ADDRESS_SQL}, t AS (SELECT {_toks(_norm('text'))} AS w FROM addr), p AS (SELECT unnest(list_transform(range(1, len(w) + 1), lambda i: {{'a': w[i], 'b': w[i + 1]}})) AS p FROM t)
SELECT p.a AS token, CAST(sum(CASE WHEN p.b IN {_in((*V.ROAD_WORDS, *V.LOCALITY_WORDS))} OR regexp_matches(p.a, '({'|'.join(V.LOCALITY_WORDS)})$') THEN 2 ELSE 1 END) AS BIGINT) AS weight FROM p
WHERE regexp_full_match(p.a, '[a-z]{{4,}}') AND p.a NOT IN {_in(V.STOP_WORDS)} GROUP BY 1 HAVING sum(1) >= 1 AND sum(CASE WHEN p.b IN {_in((*V.ROAD_WORDS, *V.LOCALITY_WORDS))} OR regexp_matches(p.a, '({'|'.join(V.LOCALITY_WORDS)})$') THEN 2 ELSE 1 END) >= 2""",
)
def _(spark, sf):
    return lexicon.geo_vocabulary(addresses(spark, sf).select(X.tokens(X.normalize_v1("text")).alias("w")), "w")


@query(
    "token_priors",
    f"""WITH {ADDRESS_SQL}, c AS (SELECT street AS token, count(*) AS n FROM addr WHERE addr_id % 2 = 0 GROUP BY 1)
SELECT token, n FROM c UNION ALL SELECT p.token, p.n FROM (SELECT 'madurai' AS token, 20 AS n UNION ALL SELECT 'salem', 15 UNION ALL SELECT 'building', 20) p WHERE p.token NOT IN (SELECT token FROM c)""",
)
def _(spark, sf):
    counts = addresses(spark, sf).where("addr_id % 2 = 0").groupBy(F.col("street").alias("token")).agg(F.count("*").alias("n"))
    known = spark.createDataFrame([("madurai",), ("building",)], "token string")
    return lexicon.with_priors(counts, known, spark.createDataFrame([("salem",), ("building",)], "token string"))


@query(
    "retarget_pairs",
    """WITH l AS (SELECT c_custkey % 40 AS s, c_custkey % 7 AS d FROM customer), m AS (SELECT DISTINCT s, CASE d WHEN 0 THEN 2 WHEN 1 THEN 2 ELSE d END AS d FROM l)
SELECT DISTINCT concat('w', s) AS src, concat('w', d) AS dst FROM m WHERE s <> d""",
)
def _(spark, sf):
    word = lambda c: F.concat(F.lit("w"), c.cast("string"))
    learned = table(spark, sf, "customer").select(word(F.col("c_custkey") % 40).alias("src"), word(F.col("c_custkey") % 7).alias("dst")).distinct()
    curated = spark.createDataFrame([("w0", "w1"), ("w1", "w2")], "src string, dst string")
    return lexicon.retarget(learned, curated).distinct()


@query(
    "city_again",
    f"WITH {ADDRESS_SQL} SELECT addr_id, concat('pune ', street, ' north mumbai') AS kept FROM addr",
)
def _(spark, sf):
    toks = F.split(F.concat(F.lit("pune "), "street", F.lit(" pune north mumbai mumbai")), " ")
    return addresses(spark, sf).select("addr_id", F.array_join(X.drop_known_again(toks, V.CITIES), " ").alias("kept"))
