"""Sentence borders learned from the texts themselves, without labels.

A full stop ends a sentence unless it belongs to an abbreviation, a number or an initial. What is an
abbreviation shows in the counts of all texts together: a word that hardly ever stands without its
stop, the likelier the shorter it is (Dunning's log-likelihood ratio, scaled by length, inner stops
and the times it stands bare). Two more ratios find words that start sentences oftener than chance
and pairs that go together over a stop. Counts are distributed aggregations; the tables learned are
words, never texts, and a second pass over the tokens decides each stop. Closing quotes and brackets
stay with the sentence that they end.

Null texts have no sentence. A document is one row of the input, and windows run within documents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codequarry.functions.text import strip_space
from codequarry.plans.placement import place
from codequarry.plans.skew import hot_keys, salted_join
from codequarry.sources.storage import written

# Fixed values, from the published method: score of an abbreviation, ratios of starters and of pairs.
ABBREVIATION, STARTER, PAIR = 0.3, 30.0, 7.88
# Probability of a stop behind an abbreviation.
STOPPED = 0.99
SPACE = r"[ \t\n\x0B\f\r]"
OPENING, CLOSING = "\"'([{“‘«„", "\"')]}”’»“"
NUMBER = "#"
# Words of a learned table up to which it is broadcast; a longer one is joined by a shuffle.
WORDS = 200_000


def tokens(docs: DataFrame) -> DataFrame:
    """doc_id, pos, raw, word, mark, lower, upper, and word and mark of the token before and of the next word.

    ``raw`` has the white space before the token, ``word`` is lower-cased without quotes, brackets and
    its end mark (numbers are '#'), ``mark`` the end mark ('' if none).
    """
    cut = place(docs.select("doc_id", "text"), "doc_id").select(
        "doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(rf"{SPACE}*+[^ \t\n\x0B\f\r]++"), F.lit(0))).alias("pos", "raw")
    )
    core = F.rtrim(F.ltrim(strip_space(F.col("raw")), F.lit(OPENING)), F.lit(CLOSING))
    last = F.right("core", F.lit(1))
    bare = F.rtrim("core", F.lit(".!?"))
    run = W.partitionBy("doc_id").orderBy("pos")
    first = F.left("core", F.lit(1))
    return (
        cut.withColumn("core", core)
        .withColumn("mark", F.when(last.isin(".", "!", "?"), last).otherwise(""))
        .withColumn("word", F.when(F.col("core").rlike("^[0-9][0-9.,]*$"), NUMBER).otherwise(F.lower(bare)))
        .withColumn("lower", (first == F.lower(first)) & (first != F.upper(first)))
        .withColumn("upper", (first != F.lower(first)) & (first == F.upper(first)))
        .select(
            "doc_id", "pos", "raw", "word", "mark", "lower", "upper",
            F.lag("word").over(run).alias("before"), F.lag("mark").over(run).alias("before_mark"),
            F.lead("word").over(run).alias("next"), F.lead("upper").over(run).alias("next_upper"),
        )
    )


def _log_part(k: Column, n: Column, x: Column) -> Column:
    """k ln x + (n - k) ln(1 - x), with 0 ln 0 = 0."""
    return F.when(k > 0, k * F.ln(x)).otherwise(0.0) + F.when(n - k > 0, (n - k) * F.ln(1 - x)).otherwise(0.0)


def likelihood_ratio(a: Column, b: Column, both: Column, n: Column) -> Column:
    """How much likelier b's rate with a differs from its rate without: Dunning's ratio, by counts."""
    rate, with_a, without = b / n, both / a, (b - both) / (n - a)
    return 2 * (
        _log_part(both, a, with_a) + _log_part(b - both, n - a, without) - _log_part(both, a, rate) - _log_part(b - both, n - a, rate)
    )


@dataclass
class SentenceModel:
    """Learned tables: words that are abbreviations, words that start sentences, words that are
    upper-case at starts only, and pairs (word, next) that go together over a stop."""

    abbreviations: DataFrame
    starters: DataFrame
    only_at_starts: DataFrame
    pairs: DataFrame


def _flagged(rows: DataFrame, table: DataFrame, key: str, flag: str) -> DataFrame:
    """``rows`` with ``flag``: whether ``key`` is in the table (word)."""
    known = table.select(F.col("word").alias(key), F.lit(True).alias(flag))
    if table.limit(WORDS + 1).count() <= WORDS:
        met = rows.join(F.broadcast(known), key, "left")
    else:
        met = salted_join(rows, known, key, ["doc_id", "pos"], hot_keys(rows, key), "left")
    return met.withColumn(flag, F.coalesce(flag, F.lit(False)))


def _special(word: str, flag: str) -> Column:
    """A word whose stop may not end a sentence: abbreviation, number or initial."""
    return F.col(flag) | (F.col(word) == NUMBER) | F.col(word).rlike(r"^\p{L}$")


def learn(toks: DataFrame) -> SentenceModel:
    """A model of all tokens together; hand in a written table."""
    words = written(toks.groupBy("word").agg(
        F.count("*").alias("n"), F.count_if(F.col("mark") == ".").alias("stopped"), F.count_if(F.col("mark") == "").alias("bare"),
        F.count_if("lower").alias("small"),
    ), "words")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("stopped"), F.lit(0)).alias("stopped")).head()
    n, rate = F.lit(float(total.n)), F.lit(total.stopped / max(1, total.n))
    a, ab = (F.col("stopped") + F.col("bare")).cast("double"), F.col("stopped").cast("double")
    inner = F.length("word") - F.length(F.replace("word", F.lit("."), F.lit("")))
    letters = (F.length("word") - inner).cast("double")
    ratio = 2 * (_log_part(ab, a, F.lit(STOPPED)) - _log_part(ab, a, rate))
    score = ratio * F.exp(-letters) * (inner + 1) * F.pow(letters, -F.col("bare"))
    lettered = F.col("word").rlike(r"\p{L}")
    abbreviations = written(words.filter((F.col("stopped") > 0) & lettered & (score >= ABBREVIATION)).select("word"), "abbreviations")

    first = _flagged(_flagged(toks, abbreviations, "word", "short"), abbreviations, "before", "before_short")
    ends = (F.col("before_mark") == ".") & ~_special("before", "before_short")
    after = F.coalesce(ends | F.col("before_mark").isin("!", "?"), F.lit(True))
    seen = first.groupBy("word").agg(F.count_if(ends).alias("starts"), F.count_if(F.col("upper") & ~after).alias("inside"))
    stats = written(seen.join(words, "word"), "starts")
    breaks = F.lit(float(stats.agg(F.coalesce(F.sum("starts"), F.lit(0))).head()[0]))
    starts, count = F.col("starts").cast("double"), F.col("n").cast("double")
    apart = (starts > 0) & (breaks < n) & lettered
    starter = apart & (starts * n > breaks * count) & (likelihood_ratio(breaks, count, starts, n) >= STARTER)
    starters = written(stats.filter(starter).select("word"), "starters")
    only = stats.filter((F.col("small") > 0) & (F.col("inside") == 0)).select("word")

    met = first.filter((F.col("mark") == ".") & _special("word", "short") & F.col("next").rlike(r"\p{L}")).groupBy("word", "next").agg(F.count("*").alias("both"))
    counts = words.select("word", F.col("n").cast("double").alias("a"))
    met = met.filter("both > 1").join(counts, "word").join(counts.select(F.col("word").alias("next"), F.col("a").alias("b")), "next")
    a, b, both = F.col("a"), F.col("b"), F.col("both").cast("double")
    together = met.filter((a < n) & (both * n > a * b) & (likelihood_ratio(a, b, F.least(both, a, b), n) >= PAIR))
    pairs = together.join(starters.withColumnRenamed("word", "next"), "next", "left_anti").select("word", "next")
    return SentenceModel(abbreviations, starters, written(only, "only-at-starts"), written(pairs, "pairs"))


def split(toks: DataFrame, model: SentenceModel) -> DataFrame:
    """doc_id, sent_id, sentence: tokens cut behind each mark that ends a sentence."""
    stops = _flagged(toks.filter((F.col("mark") == ".") & F.col("next").isNotNull()), model.abbreviations, "word", "short").filter(_special("word", "short"))
    # only stops behind special words need the other tables
    stops = _flagged(_flagged(stops, model.starters, "next", "starts"), model.only_at_starts, "next", "only")
    paired = model.pairs.withColumn("paired", F.lit(True))
    stops = stops.join(paired, ["word", "next"], "left")
    ends = F.col("next_upper") & F.col("paired").isNull() & (F.col("starts") | F.col("only"))
    kept = stops.filter(~F.coalesce(ends, F.lit(False))).select("doc_id", "pos", F.lit(True).alias("goes_on"))
    here = place(toks.select("doc_id", "pos", "raw", "mark"), "doc_id").join(place(kept, "doc_id"), ["doc_id", "pos"], "left")
    before = W.partitionBy("doc_id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    cut = F.when((F.col("mark") != "") & F.col("goes_on").isNull(), 1).otherwise(0)
    numbered = here.withColumn("cut", cut).withColumn("sent_id", F.coalesce(F.sum("cut").over(before), F.lit(0)).cast("int"))
    parts = F.array_sort(F.collect_list(F.struct("pos", "raw")))
    return numbered.groupBy("doc_id", "sent_id").agg(parts.alias("parts")).select(
        "doc_id", "sent_id", strip_space(F.array_join(F.transform("parts", lambda p: p["raw"]), "")).alias("sentence")
    )


def sentences(docs: DataFrame) -> DataFrame:
    """doc_id, sent_id, sentence of all texts, by borders learned from them."""
    toks = written(tokens(docs), "tokens")
    return split(toks, learn(toks))
