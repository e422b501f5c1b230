"""Secret scans with multipart credential linking, by built-in functions only.

Base spans: assignments to secret names, access key ids and long hex runs. Weak
parts (identifiers, secret-like values, endpoints) say little by themselves. They are
reported only if a complementary part lies in the same scope, a run of lines without a blank one,
at most REACH code points away: a secret for an identifier or endpoint, one of those for a secret.
The interval join of parts and candidates is a sweep over each document's sorted parts with running
furthest ends of each role, so no pairs are made and nothing is shuffled. The cost of a text is
n log n in its matches; runs, values and white space around separators have no greatest length.

Defined results: a null text is empty and has no spans; repeated rows each give a
row; all other columns are kept by ``with_secrets``, which refuses clashing names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table, text_of
from .spans import apart, bound, count_of, no_spans, ordered, rendered, scanned, spans

REACH = 300
BASE_KINDS = ("assign", "access", "hex")

# Fixed patterns. The possessive ends and the least lengths change no match that is kept.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]++"
HEX = r"[0-9a-f]{24,}+"
ASSIGN_GATE = r"(?i)passw(?:or)?d|secret|token|api_?key"

_SET = r"""["']?[\x20\t]*+[:=][\x20\t]*+["']?"""
IDENTIFIER = rf"(?<![A-Za-z0-9])(?i:user(?:_?name|_?id)?|login|account(?:_?id|_?name)?|client_?id|app_?id|tenant_?id|access_?key(?:_?id)?|key_?id){_SET}([A-Za-z0-9@._+-]{{3,}}+)"
SECRET = rf"(?<![A-Za-z0-9])(?i:pass(?:phrase|code)?|pwd|(?:client|access|private|secret|auth|signing|encryption)_?(?:key|code)|credentials?|auth(?:orization)?|bearer|key|sig(?:nature)?){_SET}([A-Za-z0-9+/_.=-]{{8,}}+)"
BLOB = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*+[0-9])(?=[a-z0-9+/_-]*+[A-Z])(?=[A-Z0-9+/_-]*+[a-z])[A-Za-z0-9+/_-]{32,}+={0,2}"
ENDPOINT = rf"""(?i:https?|ftps?|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqps?|s3|ldaps?|jdbc:[a-z0-9]++)://[^\x20\x09-\x0D"'<>]++|(?<![A-Za-z0-9])(?i:host(?:name)?|endpoint|server|(?:base_?)?url|region){_SET}[A-Za-z0-9.:/_-]{{4,}}+"""
WEAK_GATE = r"""(?i)[a-z_]["']?[\x20\t]*+[:=][\x20\t]*+["']?[a-z0-9@._+/-]|://|[A-Za-z0-9+/_-]{32}"""
BREAK = r"\n[\x20\t\r]*+\n"

_ROLE = {"assign": "secret", "hex": "secret", "access": "identifier", "weak_identifier": "identifier", "weak_secret": "secret", "weak_blob": "secret", "weak_endpoint": "endpoint"}


def base_spans(text: Column) -> Column:
    """The base spans of a text, sorted; a kind's pattern runs only where its gate finds something."""
    assign = F.when(text.rlike(ASSIGN_GATE), F.filter(spans(text, ASSIGN, "assign", 0, 1), lambda s: F.length(s["value"]) >= 6)).otherwise(no_spans())
    access = F.when(F.contains(text, F.lit("AKIA")), F.filter(spans(text, ACCESS, "access", 1), lambda s: F.length(s["value"]) >= 20)).otherwise(no_spans())
    run = F.when(text.rlike(r"[0-9a-f]{24}"), spans(text, HEX, "hex", 2)).otherwise(no_spans())
    return ordered(assign, access, run)


def weak_parts(text: Column, base: Column) -> Column:
    """Weak candidates that touch no base span, sorted."""
    found = ordered(spans(text, IDENTIFIER, "weak_identifier", 3, 1), spans(text, SECRET, "weak_secret", 4, 1), spans(text, BLOB, "weak_blob", 5), spans(text, ENDPOINT, "weak_endpoint", 6))
    return F.when(text.rlike(WEAK_GATE), apart(found, base)).otherwise(no_spans())


def _role(kind: Column) -> Column:
    return F.when(kind.isin([k for k, r in _ROLE.items() if r == "secret"]), "secret").when(kind == "weak_endpoint", "endpoint").otherwise("identifier")


def linked(text: Column, base: Column, weak: Column, reach: int = REACH) -> Column:
    """The weak parts that a complementary part of their scope lies within reach of, sorted."""
    # A span belongs to the scope after the breaks that start before it. Scopes and ends make one number, so that a
    # running greatest one never carries an end into a later scope.
    place = lambda scope, at: scope.cast("long") * F.lit(1 << 32) + at
    event = lambda scope, at, turn, s: F.struct(place(scope, at).alias("at"), F.lit(turn).alias("turn"), scope.alias("scope"), s.alias("span"))

    def events(all_: Column, scopes: Column) -> Column:
        # Parts are met at their starts, candidates at the furthest start that is within reach of their ends.
        met = F.transform(all_, lambda s, i: F.when(s["rank"] >= 0, event(F.get(scopes, i), s["start"], 0, s)))
        asking = F.transform(all_, lambda s, i: F.when(s["rank"] >= 3, event(F.get(scopes, i), s["end"] + reach, 1, s)))
        return F.array_sort(F.filter(F.concat(met, asking), lambda e: e.isNotNull()))

    def kept(sweep: Column) -> Column:
        ends = lambda role: F.transform(sweep, lambda e: F.when((e["turn"] == 0) & (_role(e["span"]["kind"]) == role), place(e["scope"], e["span"]["end"])))

        def chosen(secret: Column, identifier: Column, endpoint: Column) -> Column:
            partner = lambda e, i: F.when(_role(e["span"]["kind"]) == "secret", F.greatest(F.get(identifier, i), F.get(endpoint, i))).otherwise(F.get(secret, i))
            near = lambda e, i: partner(e, i) >= place(e["scope"], F.greatest(e["span"]["start"] - reach, F.lit(0)))
            return ordered(F.filter(F.transform(sweep, lambda e, i: F.when((e["turn"] == 1) & near(e, i), e["span"])), lambda s: s.isNotNull()))

        return scanned(ends("secret"), F.greatest, lambda a: scanned(ends("identifier"), F.greatest, lambda b: scanned(ends("endpoint"), F.greatest, lambda c: chosen(a, b, c))))

    count = lambda before, own: own + F.coalesce(before, F.lit(0))
    numbered = bound(ordered(spans(text, BREAK, "break", -1), base, weak), lambda all_: scanned(F.transform(all_, lambda s: F.when(s["rank"] < 0, 1).otherwise(0)), count, lambda scopes: events(all_, scopes)))
    return F.when(F.size(weak) > 0, bound(numbered, kept)).otherwise(no_spans())


def with_secrets(df: DataFrame, text: str = "text", reach: int = REACH) -> DataFrame:
    """df with base_spans and secret_spans (base ones and linked weak parts, sorted)."""
    if clash := {"base_spans", "weak_spans", "secret_spans"} & set(df.columns):
        raise ValueError(f"columns in the way: {sorted(clash)}")
    whole = text_of(text)
    rows = df.withColumn("base_spans", base_spans(whole))
    rows = rows.withColumn("weak_spans", weak_parts(whole, F.col("base_spans")))
    return rows.withColumn("secret_spans", ordered(F.col("base_spans"), linked(whole, F.col("base_spans"), F.col("weak_spans"), reach))).drop("weak_spans")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest of the base spans and all spans of every document."""
    found = with_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.col("base_spans")
    return found.select(
        "doc_id", *(count_of(base, k).alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(F.encode(rendered(base), "UTF-8"), 256).alias("base_sha256"), rendered(F.col("secret_spans")).alias("spans"),
    )
