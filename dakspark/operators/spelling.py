"""Spelling: corrections of distinct tokens by joins, then applied to rows."""

from __future__ import annotations

from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import display as D
from ..functions import similarity as S
from ..functions import text as X
from ..functions import vocabulary as V
from ..sources.writers import staged


def deletions(word: Column) -> Column:
    """The word and all it becomes by leaving out one letter: words one edit apart share one of these."""
    n = F.char_length(word)
    cut = F.transform(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        lambda i: F.concat(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1, n)),
    )
    return F.array_distinct(F.concat(F.array(word), cut))


def edit_neighbours(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Rows (word, near, n): tokens of vocabulary (token, n) one insertion, deletion, change or swap away.

    Both sides are keyed by their deletions, so the join is an equi-join; a pair is then checked.
    """
    left = words.select("word", F.explode(deletions(F.col("word"))).alias("key"))
    right = vocabulary.select(F.col("token").alias("near"), "n", F.explode(deletions(F.col("token"))).alias("key"))
    pairs = left.join(right, "key").where("word <> near").select("word", "near", "n").distinct()
    return pairs.where((F.levenshtein("word", "near") <= 1) | swapped(F.col("word"), F.col("near")))


def swapped(a: Column, b: Column) -> Column:
    """If b is a with two neighbouring letters swapped."""
    n = F.char_length(a)
    differ = F.filter(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1))
    )
    i, j = F.get(differ, F.lit(0)), F.get(differ, F.lit(1))
    cross = (F.substr(a, i, F.lit(1)) == F.substr(b, j, F.lit(1))) & (F.substr(a, j, F.lit(1)) == F.substr(b, i, F.lit(1)))
    return F.coalesce((n == F.char_length(b)) & (F.size(differ) == 2) & (j == i + 1) & cross, F.lit(False))


def deletions_two(word: Column) -> Column:
    """All that a word becomes by leaving out up to two letters: words up to two edits apart share one of these."""
    return F.array_distinct(F.flatten(F.transform(deletions(word), deletions)))


def _edits(a: str, b: str, most: int = 2) -> int:
    """Insertions, deletions, changes and swaps of neighbours that lead from a to b, swapped letters free to move on."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    far = len(a) + len(b)
    last: dict[str, int] = {}
    rows = [[far] * (len(b) + 2), [far, *range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        row, seen = [far, i], 0
        for j, y in enumerate(b, 1):
            k, m = last.get(y, 0), seen
            if x == y:
                seen = j
            row.append(min(rows[i][j] + (x != y), row[j] + 1, rows[i][j + 1] + 1, rows[k][m] + (i - k - 1) + 1 + (j - m - 1)))
        last[x] = i
        rows.append(row)
    return rows[-1][-1]


@F.pandas_udf(T.IntegerType())
def edit_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Up to two edits as they are, 3 for more.  For pairs that share a key only: Spark's levenshtein has no swaps."""
    return pd.Series([_edits(x, y) for x, y in zip(a, b)], dtype="int32")


def edit_neighbours_two(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Rows (word, near, n): tokens of vocabulary (token, n) exactly two edits away, by keys of up to two deletions.

    Two edits change a length by two at most, and letters by four, so most pairs of a key go by native tests.
    """
    left = words.select("word", F.explode(deletions_two(F.col("word"))).alias("key"))
    right = vocabulary.select(F.col("token").alias("near"), "n", F.explode(deletions_two(F.col("token"))).alias("key"))
    pairs = left.join(right, "key").where("word <> near").select("word", "near", "n").distinct()
    close = pairs.where((F.abs(F.char_length("word") - F.char_length("near")) <= 2) & (F.levenshtein("word", "near") <= 4))
    return close.where(edit_distance("word", "near") == 2)


def _likeliest(pairs: DataFrame) -> DataFrame:
    """Per word the neighbour of the largest count times keyboard weight, the first by name on ties."""
    best = Window.partitionBy("word").orderBy(F.col("weight").desc(), "near")
    return (
        pairs.withColumn("weight", F.round(F.col("n") * X.keyboard_weight(F.col("word"), F.col("near")), 9))
        .withColumn("rank", F.row_number().over(best))
        .where("rank = 1")
        .select("word", F.col("near").alias("corrected"))
    )


def norvig_correct(words: DataFrame, vocabulary: DataFrame, edits: int = 2) -> DataFrame:
    """Per word itself if known, else its likeliest neighbour one edit away, else two, else itself."""
    known = words.join(vocabulary.select(F.col("token").alias("word")), "word", "left_semi")
    new = words.join(known, "word", "left_anti")
    fixes = _likeliest(edit_neighbours(new, vocabulary))
    if edits >= 2:
        rest = new.join(fixes, "word", "left_anti")
        fixes = fixes.unionByName(_likeliest(edit_neighbours_two(rest, vocabulary)))
    return words.join(fixes, "word", "left").select("word", F.coalesce("corrected", "word").alias("corrected"))


# The least scores and lengths of the cascade's fuzzy stages.
GEO_LEAST, ROAD_LEAST, LOCALITY_LEAST, AREA_LEAST = 78.0, 75.0, 76.0, 72.0
ONE_EDIT_LEAST, TWO_EDIT_LEAST, SOUND_LEAST = 80.0, 75.0, 55.0


def geo_shortlist(words: DataFrame, names: DataFrame, relax: int = 8) -> DataFrame:
    """Rows (word, token): names that begin alike, differ by up to four in length, and share two first letters, four
    of the consonants, or 30 % of the trigrams; where fewer than `relax` do so, all that begin alike.

    An equi-join on the first letter, with the rest as a condition on its pairs.
    """
    left = words.select("word", F.substring("word", 1, 1).alias("initial"))
    right = names.select("token", F.substring("token", 1, 1).alias("initial"))
    pairs = left.join(right, "initial").where(F.abs(F.char_length("word") - F.char_length("token")) <= 4)
    sign = lambda c: F.substring(X.consonant_signature(c), 1, 4)
    alike = (
        (F.substring("word", 1, 2) == F.substring("token", 1, 2))
        | (sign("word") == sign("token"))
        | (X.ngram_containment(F.col("word"), F.col("token")) >= 0.30)
    )
    marked = pairs.withColumn("alike", alike)
    counts = marked.groupBy("word").agg(F.sum(F.col("alike").cast("int")).alias("near"))
    return marked.join(counts, "word").where(F.col("alike") | (F.col("near") < relax)).select("word", "token")


def correct_geo(contexts: DataFrame, names: DataFrame) -> DataFrame:
    """Rows (word, prev, next, corrected): words of five letters or more corrected to a name of a place, the best by
    weighted ratio, if it reaches the least score of its context and shares trigrams or consonants."""
    asks = contexts.where(F.char_length("word") >= 5)
    pairs = geo_shortlist(asks.select("word").distinct(), names)
    best = Window.partitionBy("word").orderBy(F.col("score").desc(), "token")
    top = (
        pairs.withColumn("score", S.w_ratio("word", "token")).withColumn("rank", F.row_number().over(best)).where("rank = 1").drop("rank")
    )
    least = (
        F.when(F.col("next").isin(*V.ROAD_WORDS), ROAD_LEAST).when(F.col("next").isin(*V.LOCALITY_WORDS), LOCALITY_LEAST).otherwise(GEO_LEAST)
    )
    sign = lambda c: F.substring(X.consonant_signature(c), 1, 4)
    sure = (X.ngram_containment(F.col("word"), F.col("token")) >= 0.34) | (sign("word") == sign("token"))
    return asks.join(top, "word").where((F.col("score") >= least) & sure).select("word", "prev", "next", F.col("token").alias("corrected"))


def cascade(contexts: DataFrame, vocabulary: DataFrame, names: DataFrame, misspellings: Mapping[str, str] = V.MISSPELLINGS) -> DataFrame:
    """Rows (word, prev, next, corrected, stage) of distinct words in context: the first stage that answers.

    Stages: 0 words of digits, of two letters, or protected stay; 1 city alias, `x` before a number or road word is
    `cross`; 2 dictionary; 3 known tokens stay; 4 name of a place; 5 area by ratio; 6 one edit; 7 two edits; 8 sound;
    9 unchanged.  Each stage is a join over the words that earlier ones left.
    """
    word = F.col("word")
    aliases, table = X.lookup(V.CITY_ALIASES), X.lookup(misspellings)
    protected = word.isin(*V.CITIES, *V.ROAD_WORDS, *V.LOCALITY_WORDS, *V.STOP_WORDS)
    cross = (word == "x") & (F.col("next").rlike("^[0-9]") | F.col("next").isin(*V.ROAD_WORDS) | F.col("prev").rlike("^[0-9]"))
    ruled = contexts.withColumn(
        "rule",
        F.when(aliases[word].isNotNull(), F.struct(aliases[word].alias("to"), F.lit(1).alias("stage")))
        .when(cross, F.struct(F.lit("cross").alias("to"), F.lit(1).alias("stage")))
        .when(table[word].isNotNull() & ~protected, F.struct(table[word].alias("to"), F.lit(2).alias("stage")))
        .when(~word.rlike("^[a-z]{3,}$") | protected, F.struct(word.alias("to"), F.lit(0).alias("stage"))),
    )
    known = vocabulary.select(F.col("token").alias("word")).withColumn("known", F.lit(True))
    ruled = ruled.join(known, "word", "left").withColumn(
        "rule", F.coalesce("rule", F.when(F.col("known"), F.struct(word.alias("to"), F.lit(3).alias("stage"))))
    )
    own = ["word", "prev", "next"]
    ruled = staged(ruled, "ruled")
    done = ruled.where(F.col("rule").isNotNull()).select(*own, F.col("rule.to").alias("corrected"), F.col("rule.stage").alias("stage"))
    rest = ruled.where(F.col("rule").isNull()).select(*own)
    place = staged(correct_geo(rest, names).withColumn("stage", F.lit(4)), "places")
    rest = rest.join(place.select(*own), own, "left_anti")
    left = rest.select("word").distinct()
    size, gap = F.char_length("word"), F.abs(F.char_length("word") - F.char_length("corrected"))
    alike = lambda least: S.indel_ratio("word", "corrected") >= least
    left, vocabulary = staged(left, "left"), staged(vocabulary, "vocabulary")
    area = close_words(left.where(size >= 6), names, least=AREA_LEAST).select("word", F.col("token").alias("corrected"), F.lit(5).alias("stage"))
    area = staged(area, "area")
    left = left.join(area, "word", "left_anti")
    one = _likeliest(edit_neighbours(left.where(size >= 4), vocabulary)).where(alike(ONE_EDIT_LEAST)).withColumn("stage", F.lit(6))
    one = staged(one, "one")
    left = left.join(one, "word", "left_anti")
    two = _likeliest(edit_neighbours_two(left.where(size >= 6), vocabulary)).where(alike(TWO_EDIT_LEAST) & (gap <= 3)).withColumn("stage", F.lit(7))
    two = staged(two, "two")
    left = left.join(two, "word", "left_anti")
    heard = phonetic_matches(left.where(size >= 5), vocabulary).join(vocabulary, "token")
    sound = heard.groupBy("word").agg(F.max_by("token", F.struct("n", "token")).alias("corrected")).where(alike(SOUND_LEAST))
    fixes = area.unionByName(one).unionByName(two).unionByName(sound.withColumn("stage", F.lit(8)))
    fixes = fixes.where(is_safe(F.col("word"), F.col("corrected")))
    ended = rest.join(fixes, "word", "left").select(
        *own, F.coalesce("corrected", "word").alias("corrected"), F.coalesce("stage", F.lit(9)).alias("stage")
    )
    return done.unionByName(place).unionByName(ended)


def token_contexts(rows: DataFrame, key: str, toks: str) -> DataFrame:
    """Rows (key, pos, word, prev, next) of tokens with their neighbours, the empty string at the ends."""
    end = F.lit("")
    around = F.transform(
        toks,
        lambda t, i: F.struct(
            i.alias("pos"), t.alias("word"), F.coalesce(F.get(toks, i - 1), end).alias("prev"), F.coalesce(F.get(toks, i + 1), end).alias("next")
        ),
    )
    return rows.select(key, F.explode(around).alias("t")).select(key, "t.*")


def correct_sentences(rows: DataFrame, key: str, text: str, vocabulary: DataFrame, names: DataFrame) -> DataFrame:
    """Rows (key, corrected, changes) of texts: aliases, the token cascade once for each distinct context, places before
    a road word left as they were, repeated words in a row dropped, slashes of numbers restored."""
    toks = rows.select(key, F.col(text).alias("_raw"), X.tokens(X.canonicalize(X.normalize_v1(text))).alias("_toks"))
    toks = staged(toks, "tokens")
    places = token_contexts(toks, key, "_toks")
    fixed = cascade(places.select("word", "prev", "next").distinct(), vocabulary, names)
    mended = places.join(fixed, ["word", "prev", "next"])
    kept = F.when(F.col("next").isin(*V.ROAD_WORDS) & (F.col("stage") >= 5) & (F.char_length("word") < 5), F.col("word")).otherwise(F.col("corrected"))
    gathered = mended.select(key, "pos", "word", kept.alias("to")).groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("pos", "word", "to"))).alias("_all")
    )
    out = toks.join(gathered, key, "left")
    changed = F.filter("_all", lambda x: x["word"] != x["to"])
    words = F.coalesce(F.transform("_all", lambda x: x["to"]), F.array().cast("array<string>"))
    return out.select(
        key,
        D.restore_slashes(F.col("_raw"), F.array_join(X.drop_runs(words), " ")).alias("corrected"),
        F.coalesce(
            F.transform(changed, lambda x: F.struct(x["word"].alias("src"), x["to"].alias("dst"))),
            F.array().cast("array<struct<src:string,dst:string>>"),
        ).alias("changes"),
    )


def protect(changes: Column, names: Column) -> Column:
    """Changes without those of a word that is itself a name of a place."""
    return F.filter(changes, lambda x: ~F.array_contains(names, x["src"]))


def arbitrate(original: Column, dictionary: Column, rewritten: Column, score: Column, rewritten_score: Column) -> Column:
    """The rewrite if it may be used and the language model finds it likelier than the dictionary's text, else that one."""
    usable = D.usable_rewrite(rewritten, original) & (rewritten_score > score)
    return F.when(F.coalesce(usable, F.lit(False)), rewritten).otherwise(F.coalesce(dictionary, original))


@F.pandas_udf(T.ArrayType(T.StructType().add("src", "string").add("dst", "string")))
def aligned_changes(before: pd.Series, after: pd.Series) -> pd.Series:
    """Replaced stretches of two token lists, joined by spaces, by longest matching blocks."""
    from difflib import SequenceMatcher

    out = []
    for a, b in zip(before, after):
        a, b = list(a if a is not None else ()), list(b if b is not None else ())
        found = SequenceMatcher(None, a, b, autojunk=False).get_opcodes()
        out.append([{"src": " ".join(a[i:j]), "dst": " ".join(b[k:m])} for kind, i, j, k, m in found if kind == "replace"])
    return pd.Series(out)


@F.pandas_udf(T.StringType())
def refine(text: pd.Series, trusted: pd.Series) -> pd.Series:
    """Words of a text corrected by a trusted text's words: two joined, one split, or the likest by length's least score."""
    import re

    def one(line: str, known: set[str]) -> str:
        words, out, i = line.split(), [], 0
        while i < len(words):
            low = words[i].lower()
            pair = low + words[i + 1].lower() if i + 1 < len(words) else ""
            if low in known or not low.isalpha() or len(low) < 4 or low in V.STOP_WORDS:
                out.append(words[i])
            elif pair in known:
                out.append(pair)
                i += 1
            elif cut := next((k for k in range(3, len(low) - 2) if len(low) >= 8 and low[:k] in known and low[k:] in known), 0):
                out += [low[:cut], low[cut:]]
            else:
                least = 60.0 if len(low) >= 8 else 65.0 if len(low) >= 6 else 75.0
                best = max(((S.ratio(low, k), k) for k in known if abs(len(k) - len(low)) <= 4), default=(0.0, ""))
                skeleton = lambda w: w[0] + re.sub("[aeiou]", "", w[1:])
                alike = sorted(k for k in known if skeleton(k) == skeleton(low))
                out.append(best[1] if best[0] >= least else alike[0] if alike else words[i])
            i += 1
        return " ".join(out)

    return pd.Series(
        [None if x is None else one(x, {w.lower() for w in re.findall("[A-Za-z]{3,}", y or "")}) for x, y in zip(text, trusted)], dtype="object"
    )


def close_words(words: DataFrame, vocabulary: DataFrame, least: float = 90.0, lengths: int = 3) -> DataFrame:
    """Per word the most like token with its first letter, of about its length, at `least` or more."""
    left = words.select("word", F.substring("word", 1, 1).alias("initial"))
    right = vocabulary.select("token", F.substring("token", 1, 1).alias("initial"))
    pairs = left.join(right, "initial").where(F.abs(F.char_length("word") - F.char_length("token")) <= lengths)
    best = Window.partitionBy("word").orderBy(F.col("score").desc(), "token")
    return (
        pairs.withColumn("score", S.indel_ratio("word", "token"))
        .where(F.col("score") >= least)
        .withColumn("rank", F.row_number().over(best))
        .where("rank = 1")
        .select("word", "token", F.round("score", 6).alias("score"))
    )


def phonetic_matches(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Rows (word, token) whose phonetic hashes are equal."""
    left = words.select("word", X.phonetic_hash("word").alias("hash"))
    right = vocabulary.select("token", X.phonetic_hash("token").alias("hash"))
    return left.join(right, "hash").where("word <> token").select("word", "token", "hash")


def is_safe(original: Column, fixed: Column) -> Column:
    """A correction has no digits and keeps about the length, and the first letter, the consonants or all but one sign."""
    return (
        ~original.rlike("[0-9]")
        & (F.abs(F.char_length(original) - F.char_length(fixed)) <= 3)
        & (
            (F.substring(original, 1, 1) == F.substring(fixed, 1, 1))
            | (X.consonant_signature(original) == X.consonant_signature(fixed))
            | ((F.char_length(original) >= 6) & (F.levenshtein(original, fixed) <= 1))
        )
    )


def correct_tokens(rows: DataFrame, key: str, toks: str, vocabulary: DataFrame, misspellings: Mapping[str, str] = V.MISSPELLINGS) -> DataFrame:
    """Rows with `corrected` tokens and `changes`; each distinct token is corrected once.

    In order: known tokens stay, the dictionary, a neighbour one edit away, a close word, an equal
    phonetic hash that is the only one; each stage sees what the earlier ones left.
    """
    places = rows.select(key, F.posexplode(toks).alias("pos", "word"))
    distinct = places.select("word").distinct()
    table = X.lookup(misspellings)
    plain = distinct.where(F.col("word").rlike("^[a-z]{4,}$")).join(
        vocabulary.select(F.col("token").alias("word")), "word", "left_anti"
    )
    listed = staged(plain.withColumn("corrected", table[F.col("word")]), "listed")
    vocabulary = staged(vocabulary, "vocabulary")
    rest = listed.where(F.col("corrected").isNull()).select("word")
    near = staged(norvig_correct(rest, vocabulary).where("word <> corrected"), "near")
    rest = rest.join(near, "word", "left_anti")
    close = close_words(rest, vocabulary, least=75.0).select("word", F.col("token").alias("corrected"))
    rest = rest.join(close, "word", "left_anti")
    sound = phonetic_matches(rest, vocabulary).groupBy("word").agg(F.min("token").alias("corrected"), F.count("*").alias("m")).where("m = 1")
    fixes = (
        listed.where(F.col("corrected").isNotNull())
        .unionByName(near)
        .unionByName(close)
        .unionByName(sound.select("word", "corrected"))
        .where(is_safe(F.col("word"), F.col("corrected")))
    )
    mended = places.join(fixes, "word", "left").withColumn("to", F.coalesce("corrected", "word"))
    gathered = mended.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "word", "to"))).alias("all"))
    changed = F.filter("all", lambda x: x["word"] != x["to"])
    return gathered.select(
        key,
        F.transform("all", lambda x: x["to"]).alias("corrected"),
        F.transform(changed, lambda x: F.struct(x["word"].alias("src"), x["to"].alias("dst"))).alias("changes"),
    )
