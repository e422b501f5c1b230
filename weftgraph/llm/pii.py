"""Information-theoretic sanitisation of personal data, by built-in functions only.

Base spans (email, ip, card, phone) are the protected entities. Words near their mentions are the terms that
may reveal them. Corpus counts over all documents estimate how strongly: a term t leaves

    IC(e) - PMI(e; t) = -log2 P(e | t) = log2(n_t / n_te)

bits of uncertainty about entity e, where n_t documents hold t and in n_te of them t stands near e. A term
that leaves less than REMOVE_BITS is removed wherever it occurs, one that leaves less than GENERALISE_BITS is replaced
by its class. At least two different texts must show the pair, so that words seen once, and exact copies of
a text, are no evidence; a term must also be rarer than the corpus at large: entities in every document
carry no information.

A term is a whole run of letters and digits, of any length; it is near if it is among the NEAR terms before or after the entity.
Counting pre-aggregates per task. Candidate and disclosing terms are broadcast only after
they were counted and found at most BROADCAST_TERMS; beyond that the joins shuffle.

Defined results: a null text is empty and stays null when sanitised; rows are told apart by id and text, so rows
that repeat both get the same result; null ids are ids like others; ``sanitised`` keeps all other columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import DOCUMENT_COLUMNS, looked_up, materialize, table, text_of
from .spans import apart, bound, count_of, merged, no_spans, ordered, rendered, replaced, scanned, spans

REMOVE_BITS = 0.5
GENERALISE_BITS = 1.5
NEAR = 10
BROADCAST_TERMS = 100_000
BASE_KINDS = ("email", "ip", "card", "phone")

# Fixed patterns. An email begins where a run of its characters begins or the last match ended; possessive
# runs, and the least number of digits of a card, change no match that is kept.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IP_PARTS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$"
TERM_BREAK = r"[^\p{L}\p{N}]+"
TERM = r"[\p{L}\p{N}]++"


def base_spans(text: Column) -> Column:
    """The base spans of a text, sorted; a kind's pattern runs only where its gate finds something."""
    digits = F.regexp_replace
    gated = lambda gate, found: F.when(gate, found).otherwise(no_spans())
    email = gated(F.contains(text, F.lit("@")), spans(text, EMAIL, "email", 0))
    ip = gated(text.rlike(r"[0-9]\.[0-9]"), F.filter(spans(text, IP, "ip", 1), lambda s: s["value"].rlike(IP_PARTS)))
    card = gated(
        text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"),
        F.filter(spans(text, CARD, "card", 2), lambda s: F.length(digits(s["value"], "[^0-9]", "")).between(14, 19) & F.call_function("luhn_check", digits(s["value"], "[^0-9]", ""))),
    )
    phone = gated(F.contains(text, F.lit("+")), F.filter(spans(text, PHONE, "phone", 3), lambda s: F.length(digits(s["value"], "[^0-9]", "")).between(10, 15)))
    return ordered(email, ip, card, phone)


def _entity(s: Column) -> Column:
    number = F.regexp_replace(s["value"], "[^0-9]", "")
    return F.concat_ws(":", s["kind"], F.when(s["kind"].isin("card", "phone"), number).otherwise(F.lower(s["value"])))


def _terms(text: Column) -> Column:
    """The distinct terms of a text."""
    return F.array_distinct(F.split(F.lower(text), TERM_BREAK, -1))


def _mentions(text: Column, base: Column, near: int) -> Column:
    """(entity, terms near it) for each base span; what base spans cover holds no terms."""
    blank = replaced(text, merged(base), lambda s, _: F.repeat(F.lit(" "), s["end"] - s["start"]))
    count = lambda before, own: own + F.coalesce(before, F.lit(0))

    def mention(s: Column, words: Column, before: Column) -> Column:
        first = F.greatest(before - near, F.lit(0))
        return F.struct(_entity(s).alias("entity"), F.array_distinct(F.transform(F.slice(words, first + 1, before - first + near), lambda w: F.lower(w["value"]))).alias("terms"))

    def found(words: Column, events: Column, passed: Column) -> Column:
        return F.filter(F.transform(events, lambda s, i: F.when(s["rank"] < 4, mention(s, words, F.get(passed, i)))), lambda m: m.isNotNull())

    def placed(words: Column) -> Column:
        return bound(ordered(base, words), lambda events: scanned(F.transform(events, lambda s: F.when(s["rank"] == 4, 1).otherwise(0)), count, lambda passed: found(words, events, passed)))

    return bound(spans(blank, TERM, "term", 4), placed)


def disclosing_terms(df: DataFrame, text: str = "text", remove: float = REMOVE_BITS, generalise: float = GENERALISE_BITS, near: int = NEAR) -> DataFrame:
    """(term, action, bits): terms by the least bits that they leave about any entity; counts are over all of df."""
    whole = text_of(text)
    shown = (
        df.select(whole.alias("text")).withColumn("base", base_spans(F.col("text"))).filter(F.size("base") > 0)
        .select(F.xxhash64("text").alias("seen"), _mentions(F.col("text"), F.col("base"), near).alias("mentions"))
    )
    pair = lambda m: F.transform(m["terms"], lambda t: F.struct(m["entity"].alias("entity"), t.alias("term")))
    shown = materialize(shown.select("seen", F.array_distinct(F.transform("mentions", lambda m: m["entity"])).alias("entities"), F.array_distinct(F.flatten(F.transform("mentions", pair))).alias("pairs")), "mentions")
    pairs = (
        shown.select("seen", F.explode("pairs").alias("p")).groupBy("p.entity", "p.term", "seen").agg(F.count("*").alias("rows"))
        .groupBy("entity", "term").agg(F.sum("rows").alias("n_te"), F.count("*").alias("texts")).filter("texts >= 2").drop("texts")
    )
    pairs = materialize(pairs, "pairs")
    # An entity may have very many terms, and a term very many entities: both are looked up, not joined.
    entities = shown.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_e"))
    entities = materialize(pairs.groupBy("entity").agg(F.count("*").alias("rows")).join(entities, "entity"), "entities")
    pairs = looked_up(pairs, entities, "entity", "rows")
    terms = materialize(pairs.groupBy("term").agg(F.count("*").alias("rows")), "terms")
    every = df.select(F.explode(_terms(whole)).alias("term"))
    if terms.count() <= BROADCAST_TERMS:
        every = every.join(F.broadcast(terms.select("term")), "term", "left_semi")
    counted = materialize(every.groupBy("term").agg(F.count("*").alias("n_t")).join(terms, "term"), "counted")
    everything = df.count()
    left = F.log2(F.col("n_t") / F.col("n_te"))
    gained = F.log2(F.lit(float(max(everything, 1))) * F.col("n_te") / (F.col("n_t") * F.col("n_e")))
    found = looked_up(pairs, counted, "term", "rows").withColumn("bits", left).filter((left < generalise) & (gained > 1))
    return materialize(found.groupBy("term").agg(F.min("bits").alias("bits")).withColumn("action", F.when(F.col("bits") < remove, "remove").otherwise("generalise")), "disclosing")


def _listed(df: DataFrame, key: str, text: str, terms: DataFrame) -> tuple[DataFrame, bool]:
    """(row_key, row_text, listed): the disclosing terms of each row that holds any; and whether they are few enough to broadcast."""
    whole = text_of(text)
    held = df.select(F.col(key).alias("row_key"), F.xxhash64(whole).alias("row_text"), F.explode(_terms(whole)).alias("term"))
    few = terms.count() <= BROADCAST_TERMS
    held = held.join(F.broadcast(terms) if few else terms, "term")
    listed = materialize(held.groupBy("row_key", "row_text").agg(F.collect_set(F.struct("term", "action")).alias("listed")), "listed")
    size = listed.agg(F.sum(F.size("listed")).alias("n")).first()["n"] or 0
    return listed, size <= BROADCAST_TERMS


def with_spans(df: DataFrame, key: str = "doc_id", text: str = "text", remove: float = REMOVE_BITS, generalise: float = GENERALISE_BITS, near: int = NEAR) -> DataFrame:
    """df with base_spans, and term_spans (kind term, value the action) that overlap none of them."""
    if clash := {"base_spans", "term_spans", "listed", "row_key", "row_text"} & set(df.columns):
        raise ValueError(f"columns in the way: {sorted(clash)}")
    whole = text_of(text)
    listed, few = _listed(df, key, text, disclosing_terms(df, text, remove, generalise, near))
    match = df[key].eqNullSafe(listed["row_key"]) & (F.xxhash64(whole) == listed["row_text"])
    rows = df.join(F.broadcast(listed) if few else listed, match, "left").withColumn("base_spans", base_spans(whole))
    free = apart(_term_spans(whole, F.col("listed")), F.col("base_spans"))
    return rows.withColumn("term_spans", F.when(F.col("listed").isNotNull(), free).otherwise(no_spans())).drop("listed", "row_key", "row_text")


def _term_spans(text: Column, listed: Column) -> Column:
    """The spans of a text's words that are listed, value the action: words are sorted behind the listed terms, and each looks at the last one."""
    terms = F.transform(listed, lambda x: F.struct(x["term"].alias("word"), F.lit(0).alias("turn"), F.lit(0).alias("start"), F.lit(0).alias("end"), x["action"].alias("action")))
    words = F.transform(spans(text, TERM, "term", 4), lambda s: F.struct(F.lower(s["value"]).alias("word"), F.lit(1).alias("turn"), s["start"].alias("start"), s["end"].alias("end"), F.lit(None).cast("string").alias("action")))

    def chosen(events: Column, known: Column) -> Column:
        acted = F.transform(events, lambda e, i: F.when((e["turn"] == 1) & (F.get(known, i)["word"] == e["word"]), F.struct(
            e["start"].alias("start"), F.lit(4).alias("rank"), e["end"].alias("end"), F.lit("term").alias("kind"), F.get(known, i)["action"].alias("value"))))
        return F.array_sort(F.filter(acted, lambda s: s.isNotNull()))

    known = lambda events: F.transform(events, lambda e: F.when(e["turn"] == 0, F.struct(e["word"].alias("word"), e["action"].alias("action"))))
    return bound(F.array_sort(F.concat(terms, words)), lambda events: scanned(known(events), lambda before, own: F.coalesce(own, before), lambda last: chosen(events, last)))


def _label(s: Column, word: Column) -> Column:
    kind = F.when(word.rlike(r"[0-9]"), "<CODE>").when(word.rlike(r"^\p{Lu}"), "<NAME>").otherwise("<WORD>")
    return F.when(s["kind"] != "term", F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))).when(s["value"] == "remove", "").otherwise(kind)


def sanitised(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df with its texts sanitised: base spans labelled, disclosing terms removed or put by their class."""
    rows = with_spans(df, key, text)
    # Overlapping spans are replaced as one, so that nothing of the later one is left.
    found = merged(ordered(F.col("base_spans"), F.col("term_spans")))
    clean = replaced(F.col(text), found, _label)
    touched = (F.size("base_spans") > 0) | (F.size("term_spans") > 0)
    return rows.withColumn(text, F.when(touched, clean).otherwise(F.col(text))).drop("base_spans", "term_spans")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest of the base spans and all spans of every document."""
    found = with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.col("base_spans")
    return found.select(
        "doc_id", *(count_of(base, k).alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(F.encode(rendered(base), "UTF-8"), 256).alias("base_sha256"), rendered(ordered(base, F.col("term_spans"))).alias("spans"),
    )


def sanitise_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: all documents with sanitised texts and their lengths."""
    docs = sanitised(docs.select(*DOCUMENT_COLUMNS))
    return docs.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*DOCUMENT_COLUMNS)
