"""Personal data: patterns, and the terms that reveal what the patterns protect.

Patterns find emails, ip addresses, card and phone numbers (the base spans). Each distinct value
is a protected entity. A term discloses an entity when knowing the term tells most of what there is
to know about it: with document frequencies over the whole corpus, the pointwise mutual information
of entity and term is divided by the information content of the entity,

    disclosure(e, t) = log(n(e,t) N / (n(e) n(t))) / log(N / n(e)),

1 when the term stands in no document but the entity's. All four counts are over whole documents,
and a term is one outside of emails. Every entity is judged, however rare. So that terms are not
taken for revealing which chance put there, each distinct line of an entity counts as one draw (so
copies are no evidence of their own), and the number of the corpus's terms that would stand beside
as many of the entity's lines by chance must be at most ``chance``. One line can only pass where
the corpus has few terms for its documents; two lines do where a rare term stands beside both.
Terms at ``threshold`` or more become spans of kind ``term`` wherever they stand. ``sanitise``
writes texts in which base spans and fully revealing terms are removed and the other terms are
generalised.

Everything is DataFrame work; positions are code points. A null text counts as empty and has no
spans. Texts of any length are read whole: the patterns are linear in the text. Repeated rows all
get the spans of their text, and so do rows without an id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from codequarry.llm.common import BROADCAST_ROWS, broadcast_if_small
from codequarry.sources.storage import written

KINDS = ("email", "ip", "card", "phone", "term")
# The contracted patterns. Possessive repeats and a fixed left border find the same matches
# without going back over long runs: a match never begins inside a run that it could take whole.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# A cheap test that every text with a match passes.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]"}
TERM = r"\p{L}{3,}"
# What tells texts apart: the id as text (empty for none) and the text's hash.
KEY = ["doc_key", "text_hash"]


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check sum."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def valid(kind: Column, found: Column) -> Column:
    """Whether a match is kept."""
    digits = _digits(found)
    n = F.length(digits)
    small = F.forall(F.split(found, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike(r"^([0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    return (
        F.when(kind == 0, F.lit(True)).when(kind == 1, small)
        .when(kind == 2, F.when(n.between(12, 19), luhn(digits)).otherwise(F.lit(False)))
        .otherwise(n.between(9, 15))
    )


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    number = F.col("doc_id").cast("bigint")
    key = F.coalesce(number.cast("string"), F.lit(""))
    return docs.select(number.alias("doc_id"), text.alias("text"), key.alias("doc_key"), F.xxhash64(text).alias("text_hash"))


def base_matches(docs: DataFrame) -> DataFrame:
    """row, doc_key, text_hash, kind, start, end, found, line: every valid match.

    ``row`` numbers the rows of ``docs``. ``line`` is the rest of the match's line on both sides,
    up to the next match of its kind.
    """
    text, each = F.col("text"), []
    for number, (kind, pattern) in enumerate(PATTERNS.items()):
        could = text.contains(HINTS[kind]) if kind == "email" else text.rlike(HINTS[kind])
        none = F.array().cast("array<string>")
        each.append(F.struct(
            F.lit(number).alias("kind"), F.when(could, F.split(text, pattern, -1)).otherwise(none).alias("parts"),
            F.when(could, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none).alias("found"),
        ))
    rows = _texts(docs).withColumn("row", F.monotonically_increasing_id())
    rows = rows.select("row", *KEY, F.explode(F.array(*each)).alias("k")).filter(F.size("k.found") > 0)
    around = F.transform(F.col("k.found"), lambda m, i: F.struct(
        m.alias("found"), (F.length(F.get("k.parts", i))).alias("gap"),
        F.concat(
            F.substring_index(F.get("k.parts", i), "\n", -1), F.lit(" "), F.substring_index(F.get("k.parts", i + 1), "\n", 1)
        ).alias("line"),
    ))
    rows = rows.select("row", *KEY, F.col("k.kind").alias("kind"), F.posexplode(around).alias("i", "m")).select("row", *KEY, "kind", "i", "m.*")
    so_far = W.partitionBy("row", "kind").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("found")).over(so_far)
    rows = rows.withColumn("end", end).filter(valid(F.col("kind"), F.col("found")))
    return rows.select("row", *KEY, "kind", (F.col("end") - F.length("found")).alias("start"), "end", "found", "line")


def entity(kind: Column, found: Column) -> Column:
    """One name for all spellings of a value."""
    return F.concat_ws(":", kind.cast("string"), F.when(kind <= 1, F.lower(found)).otherwise(_digits(found)))


def _terms(text: str | Column) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(TERM), F.lit(0)))


def _outside(text: Column) -> Column:
    """A text without its emails, the only protected values that hold letters."""
    return F.when(text.contains(HINTS["email"]), F.regexp_replace(text, PATTERNS["email"], " ")).otherwise(text)


def joint_counts(docs: DataFrame, matches: DataFrame) -> DataFrame:
    """entity, term, n_et, k_et, n_e, k_e: documents, and distinct lines of the entity, with both and with the entity."""
    seen = matches.select("row", "text_hash", entity(F.col("kind"), F.col("found")).alias("entity"), F.xxhash64("line").alias("line"))
    held = seen.groupBy("text_hash", "entity", "row").agg(F.min("line").alias("line")).groupBy("text_hash", "entity")
    held = written(held.agg(F.count("*").alias("n"), F.min("line").alias("line")), "entities")
    whole = held.groupBy("entity", "line").agg(F.sum("n").alias("n")).groupBy("entity").agg(F.sum("n").alias("n_e"), F.count("*").alias("k_e"))
    texts = _texts(docs).join(broadcast_if_small(held.select("text_hash").distinct()), "text_hash", "left_semi")
    texts = texts.select("text_hash", _terms(_outside(F.col("text"))).alias("terms")).groupBy("text_hash").agg(F.first("terms").alias("terms"))
    pairs = texts.join(held, "text_hash").select("entity", "line", "n", F.explode("terms").alias("term"))
    joint = pairs.groupBy("entity", "term", "line").agg(F.sum("n").alias("n")).groupBy("entity", "term")
    return joint.agg(F.sum("n").alias("n_et"), F.count("*").alias("k_et")).join(broadcast_if_small(whole), "entity")


def expected(terms: Column, k_et: Column, k_e: Column, share: Column) -> Column:
    """How many of ``terms`` terms, each on ``share`` of the documents, chance puts beside an entity that often (at most).

    The Chernoff bound of k_et or more hits among k_e lines.
    """
    part = k_et / k_e
    rest = F.when(part < 1, (1 - part) * F.log((1 - part) / (1 - share))).otherwise(F.lit(0.0))
    return F.when(part > share, terms * F.exp(-k_e * (part * F.log(part / share) + rest))).otherwise(terms)


def revealing_terms(docs: DataFrame, matches: DataFrame, threshold: float = 0.8, min_lines: int = 1, chance: float = 0.01) -> DataFrame:
    """term, disclosure: the terms that reveal some entity, with the highest value over entities."""
    size = docs.select(F.count("*").alias("total")).first()["total"]
    words = _texts(docs).select(F.explode(_terms(_outside(F.col("text")))).alias("term"))
    known = float(words.select(F.approx_count_distinct("term", 0.02)).first()[0])
    total = F.lit(float(size))
    joint = joint_counts(docs, matches).filter(F.col("k_et") >= min_lines)
    # a term stands in n_et documents at least: what could be chance even so is decided before it is counted
    likely = expected(F.lit(known), F.col("k_et"), F.col("k_e"), F.col("n_et") / total) <= chance
    joint = written(joint.filter(likely), "joint")
    candidates = written(joint.select("term").distinct(), "candidates")
    in_docs = words.join(broadcast_if_small(candidates), "term").groupBy("term").agg(F.count("*").alias("n_t"))
    told = F.log(F.col("n_et") * total / (F.col("n_e") * F.col("n_t")))
    content = F.log(total / F.col("n_e"))
    measured = joint.join(in_docs, "term").filter(expected(F.lit(known), F.col("k_et"), F.col("k_e"), F.col("n_t") / total) <= chance)
    measured = measured.withColumn("disclosure", F.when(content > 0, F.least(F.lit(1.0), told / content)).otherwise(F.lit(0.0)))
    return measured.groupBy("term").agg(F.max("disclosure").alias("disclosure")).filter(F.col("disclosure") >= threshold)


def term_matches(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_key, text_hash, start, end, disclosure of every place where one of the (written) terms stands.

    A text travels only where the terms are too many for a broadcast, and then once if it holds one.
    """
    texts = _texts(docs)
    forms = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(TERM), F.lit(0)))).alias("form")
    if terms.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        held = texts.select(*KEY, "text", forms).withColumn("term", F.lower("form")).join(F.broadcast(terms), "term")
    else:
        pairs = texts.select(*KEY, forms).withColumn("term", F.lower("form")).join(terms, "term").distinct()
        held = texts.join(pairs, KEY)
    # a form is all letters; cut at it, the parts of the text tell where it stands
    alone = F.concat(F.lit(r"(?<!\p{L})"), "form", F.lit(r"(?!\p{L})"))
    gaps = F.transform(F.split("text", alone, F.lit(-1)), F.length)
    rows = held.withColumn("row", F.monotonically_increasing_id()).select(
        "row", *KEY, "disclosure", F.length("form").alias("size"), F.posexplode(F.slice(gaps, F.lit(1), F.size(gaps) - 1)).alias("i", "gap")
    )
    so_far = W.partitionBy("row").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(so_far))
    return rows.select(*KEY, (F.col("end") - F.col("size")).alias("start"), "end", "disclosure").distinct()


def find_spans(docs: DataFrame, threshold: float = 0.8, min_lines: int = 1) -> DataFrame:
    """doc_key, text_hash, kind (place in KINDS), start, end, disclosure: all spans of all texts."""
    matches = written(base_matches(docs), "pii")
    spans = matches.select(*KEY, "kind", "start", "end", F.lit(1.0).alias("disclosure")).distinct()
    terms = written(revealing_terms(docs, matches, threshold, min_lines), "terms")
    if terms.isEmpty():
        return spans
    more = term_matches(docs, terms).select(*KEY, F.lit(4).alias("kind"), "start", "end", "disclosure")
    return written(spans.unionByName(more), "spans")


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def span_digest(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, counts of base spans, base_sha256, spans: one row per document."""
    each = F.struct("start", "kind", "end")
    counts = [F.count_if(F.col("kind") == i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])]
    grouped = spans.groupBy(*KEY).agg(
        *counts, _listed(F.collect_list(F.when(F.col("kind") < 4, each))).alias("base"), _listed(F.collect_list(each)).alias("spans")
    )
    rows = _texts(docs).select("doc_id", *KEY).join(grouped, KEY, "left")
    return rows.select(
        "doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("bigint").alias(f"n_{k}") for k in KINDS[:4]],
        F.sha2(F.coalesce("base", F.lit("")).cast("binary"), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"),
    )


def sanitise(docs: DataFrame, spans: DataFrame, remove_at: float = 0.95) -> DataFrame:
    """doc_id, text: each span replaced by its kind; terms of ``remove_at`` disclosure or more go.

    Spans that overlap are replaced as one, named after the first.
    """
    order = W.partitionBy(*KEY).orderBy("start", "kind", "end")
    before = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    islands = spans.withColumn("new", F.coalesce((F.col("start") >= before).cast("int"), F.lit(1)))
    islands = islands.withColumn("island", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    name = F.get(F.array(*map(F.lit, KINDS)), F.col("kind"))
    label = F.when((F.col("kind") == 4) & (F.col("disclosure") >= remove_at), F.lit("")).otherwise(F.concat(F.lit("<"), name, F.lit(">")))
    islands = islands.groupBy(*KEY, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by(label, F.struct("start", "kind", "end")).alias("label"))
    listed = islands.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("start", "end", "label"))).alias("cuts"))
    rows = _texts(docs).join(listed, KEY, "left")
    last = lambda i: F.when(i > 0, F.get("cuts", i - 1)["end"]).otherwise(F.lit(0)).cast("int")
    parts = F.transform("cuts", lambda c, i: F.concat(F.substring(F.col("text"), last(i) + 1, (c["start"] - last(i)).cast("int")), c["label"]))
    rest = F.substring(F.col("text"), last(F.size("cuts")) + 1, F.length("text"))
    return rows.select("doc_id", F.when(F.col("cuts").isNull(), F.col("text")).otherwise(F.concat(F.array_join(parts, ""), rest)).alias("text"))
