"""Spelling variants by pivotal grams.

A word's bigrams are ordered from rare to frequent (over all words); its first three, one more than an edit can
touch, are its prefix (with all grams equal to the third). Two of the three that don't overlap are its pivots, chosen by
dynamic programming so that their lists are shortest. An edit leaves one of two disjoint grams whole, so of two near words
the one whose prefix ends first has a pivot that lies in the other's prefix, as many letters from the start if the edit is
behind it, from the end if it is before. So pivots are joined with prefixes by the gram and the text on the side without the
edit. Where that side is short, the other is cut in half and one half must be equal too; else the grams at a word's ends
would meet in long lists. What meets is verified by the edit distance.

Null texts have no words, empty ones neither; a null doc_id counts as the empty text before the colon. Repeated
rows count as often as they come. Of near words with the same count the smallest in code-point order is the form. Empty
tables give no rows. Extra columns are not read. Long texts are read whole.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

LETTERS = r"A-Za-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: One run of so many loses a letter, by the crc of its document and itself.
DELETES = 31
#: A form occurs at least so many times as often as the word.
FORM_RATIO = 10
GRAM = 2
#: A side of a gram with fewer letters than this is short. Words are long enough for one side not to be.
SHORT = 3


def counted_words(docs: DataFrame, least: int = LEAST_LENGTH, occurrences: int = LEAST_COUNT, deletes: int = DELETES) -> DataFrame:
    """word, n: runs of letters, lower-cased in A-Z, with the given deletions; counted in the tasks before the shuffle.

    A shorter run can't become a word, so only runs of `least` letters or more are taken out of a text. (Outer explodes,
    here and below: for inner ones Spark first filters by the array's size and computes the array twice.)
    """
    found = F.regexp_extract_all("text", F.lit(f"([{LETTERS}]{{{least},}})"), F.lit(1))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode_outer(found).alias("run"))
    runs = runs.select("doc", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", string.ascii_uppercase, string.ascii_lowercase)).otherwise(F.col("run")).alias("run"))
    runs = runs.select("run", F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    words = runs.select(F.when(F.col("h") % deletes == 0, shorter).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= occurrences)


def pivots(prefix: Column, wanted: int = 2, gram: int = GRAM) -> Column:
    """Of grams (weight, gram, place) the `wanted` that don't overlap and weigh least in sum: for each number of chosen
    grams, and each gram as the last of them, the lightest choice; a gram is added to the choices that end before it."""
    chosen = F.transform(prefix, lambda x: F.struct(x["weight"].alias("sum"), x["at"].alias("at"), F.array(x).alias("grams")))

    def grown(before: Column):
        def add(x):
            best = F.array_min(F.filter(before, lambda y: y["at"] <= x["at"] - gram))
            return F.when(best.isNotNull(), F.struct((best["sum"] + x["weight"]).alias("sum"), x["at"].alias("at"), F.array_append(best["grams"], x).alias("grams")))

        return F.array_compact(F.transform(prefix, add))

    for _ in range(wanted - 1):
        chosen = grown(chosen)
    return F.array_min(chosen)["grams"]


def signatures(words: DataFrame, gram: int = GRAM) -> DataFrame:
    """words with prefix (their rarest grams), pivots and `last`, the prefix's end in the order of grams.

    The alphabet has 90 letters, so there are at most 8,100 bigrams to broadcast.
    """
    places = F.transform(F.sequence(F.lit(1), F.length("word") - gram + 1), lambda i: F.struct(F.col("word").substr(i, F.lit(gram)).alias("gram"), i.alias("at")))
    grams = words.select("word", "n", F.explode(places).alias("g")).select("word", "n", "g.gram", "g.at")
    weights = grams.groupBy("gram").agg(F.count("*").alias("weight"))
    weighed = grams.join(F.broadcast(weights), "gram").groupBy("word", "n").agg(F.array_sort(F.collect_list(F.struct("weight", "gram", "at"))).alias("grams"))
    order = lambda g: F.struct(g["weight"], g["gram"])
    first = weighed.select("word", "n", "grams", order(F.col("grams")[gram]).alias("last"))
    return first.select("word", "n", "last", F.filter("grams", lambda g: order(g) <= F.col("last")).alias("prefix"), pivots(F.slice("grams", 1, gram + 1)).alias("pivots"))


def meeting_keys(first: bool, gram: int = GRAM) -> Column:
    """Hashes of what two near words share at a gram that the edit leaves whole (columns word, at): of the word's begin up to
    the gram's end, or of its end from the gram on.

    By how much the second word is longer is unknown, so keys of halves are made for each case; they hold the
    length of the first word.
    """
    word, at, length = F.col("word"), F.col("at"), F.length("word")
    begin, end = F.left(word, at + (gram - 1)), F.right(word, length - at + 1)
    before, after = at - 1, length - at - (gram - 1)
    whole_begin, whole_end = F.xxhash64(F.lit(1), begin), F.xxhash64(F.lit(2), end)
    case = lambda kind, longer: (F.lit(kind), at if kind < 5 else after, length if first else length - longer, F.lit(longer))
    half = lambda n, longer: F.shiftright(n if first else n - longer, 1)
    behind, ahead = [], []
    for longer in (0, 1, -1):
        h = half(after, longer)
        behind.append(F.xxhash64(*case(3, longer), F.left(word, at + (gram - 1) + h)))
        behind.append(F.xxhash64(*case(4, longer), begin, F.right(word, (after if first else after - longer) - h)))
        h = half(before, longer)
        ahead.append(F.xxhash64(*case(5, longer), F.left(word, h), end))
        ahead.append(F.xxhash64(*case(6, longer), F.right(word, (length if first else length - longer) - h)))
    some = F.when(before < SHORT, F.array(whole_end, *behind)).when(after < SHORT, F.array(whole_begin, *ahead))
    return some.otherwise(F.array(whole_begin, whole_end))


def near_pairs(words: DataFrame) -> DataFrame:
    """a, n_a, b, n_b: each pair of words (word, n; distinct) that one inserted, deleted or replaced code point parts, once."""
    s = cut(signatures(words))

    def side(grams: str, first: bool, word: str, n: str) -> DataFrame:
        rows = s.select("word", "n", "last", F.explode(grams).alias("g")).select("word", "n", "last", "g.gram", "g.at")
        return rows.select(F.col("word").alias(word), F.col("n").alias(n), F.col("last").alias(f"last_{word}"), F.explode_outer(meeting_keys(first)).alias("key"))

    earlier = F.struct("last_a", "a") < F.struct("last_b", "b")
    met = side("pivots", True, "a", "n_a").hint("merge").join(side("prefix", False, "b", "n_b"), "key").where(earlier & (F.levenshtein("a", "b", 1) == 1))
    return met.select("a", "n_a", "b", "n_b").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """word, root of words that have a form: forms followed to the last. A form is much more frequent than its word, so
    chains are short; each round doubles how far a word looks."""
    at = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = cut(at.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        at = new.select("word", "root")
        if not new.where("moved").limit(1).count():
            return at


def variants(words: DataFrame, ratio: int = FORM_RATIO) -> DataFrame:
    """word, n, n_near, form, form_n, root of all words (word, n; distinct)."""
    words = cut(words.select("word", "n"))
    pairs = cut(near_pairs(words))
    both = pairs.select(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("near"), F.col("n_b").alias("near_n"))
    both = both.unionByName(pairs.select(F.col("b").alias("word"), F.col("n_b").alias("n"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.first("n").alias("own"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    has = -F.col("best.less") >= ratio * F.col("own")
    best = cut(best.select("word", "n_near", F.when(has, F.col("best.near")).alias("form"), F.when(has, -F.col("best.less")).alias("form_n")))
    root = roots(best.where("form IS NOT NULL"))
    out = words.join(best, "word", "left").join(root, "word", "left")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))
