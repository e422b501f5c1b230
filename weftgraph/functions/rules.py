"""Ordered rules as column expressions: types, admissibility, scope, question intent, weights."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import QUALIFIER, bound, stripped

PERIOD = (1890, 1945)


def first_of(*rules: tuple[Column, Column]) -> Column:
    """The value of the first rule that holds, else null."""
    (condition, value), *rest = rules
    return reduce(lambda chain, rule: chain.when(*rule), rest, F.when(condition, value))


def _matched(column: Column, pattern: str) -> Column:
    return F.regexp_extract(column, f"({pattern})", 1)


def entity_type(title: Column, categories: Column) -> Column:
    """struct(type, reason) of a page by its categories and the end of its title."""
    some = F.size(categories) > 0
    verdict = lambda kind, reason: F.struct(F.lit(kind).cast("string").alias("type"), reason.alias("reason"))

    def by(column: Column, kind: str | None, label: str, pattern: str, also: Column | None = None) -> tuple[Column, Column]:
        holds = column.rlike(pattern)
        return (holds if also is None else also & holds), verdict(kind, F.concat(F.lit(f"{label}:"), _matched(column, pattern)))

    def judged(names: Column) -> Column:
        base, joined = names["base"], names["joined"]
        return F.coalesce(
            first_of(
                by(joined, None, "non_entity", fixed.NON_ENTITY_CATEGORY, some),
                by(joined, "Person", "category", fixed.PERSON_CATEGORY, some),
                by(base, "Event", "title_suffix", fixed.EVENT_TITLE),
                by(joined, "Organization", "category", fixed.ORGANIZATION_CATEGORY, some),
                by(base, "Organization", "title_suffix", fixed.ORGANIZATION_TITLE),
                by(joined, "Event", "category", fixed.EVENT_CATEGORY, some),
            ),
            verdict(None, F.lit("unclassified")),
        )

    return bound(F.struct(stripped(F.regexp_replace(title, QUALIFIER, "")).alias("base"), F.array_join(categories, " / ").alias("joined")), judged)


def dropped_reason(name: Column, least: int = 2) -> Column:
    """Why a name is no entity, or null."""
    return bound(
        name,
        lambda n: first_of(
            (n.contains("목록") | n.contains("일람"), F.lit("list_page")),
            (n.rlike(fixed.POSITION_TITLE), F.lit("position_title")),
            (F.length(n) < least, F.lit("too_short")),
            (n.isin(*fixed.STOPWORDS), F.lit("stopword")),
            (n.rlike(r"(?U)^[\d\W_]+$"), F.lit("non_entity")),
        ),
    )


def abbreviated(name: Column) -> Column:
    """The full name of a short one, else the name itself."""
    table = F.create_map(*(F.lit(x) for pair in fixed.ABBREVIATIONS.items() for x in pair))
    return bound(name, lambda n: F.coalesce(F.try_element_at(table, n), n))


def title_block(title: Column) -> Column:
    """Why a title is left out of a corpus, or null."""
    return first_of(*((title.rlike(pattern), F.lit(reason)) for pattern, reason in fixed.TITLE_BLOCKS))


def noise_category(category: Column) -> Column:
    """Whether a category says nothing about the topic."""
    body = F.regexp_replace(category, r"^[^:]*:", "")
    named = reduce(lambda a, b: a | b, (body.contains(w) for w in fixed.CATEGORY_NOISE))
    return named | body.rlike("|".join(f"(?:{p})" for p in fixed.GENERIC_CATEGORIES))


def _last_year(categories: Column, pattern: str) -> Column:
    found = F.filter(categories, lambda c: c.rlike(pattern))
    return F.when(F.size(found) > 0, F.regexp_extract(F.get(found, F.size(found) - 1), pattern, 1).cast("int"))


def topic_scope(categories: Column) -> Column:
    """Why a page is out of the topic, by its categories, or null: period, topic, arts, office, nationality."""
    count = lambda pattern: F.size(F.filter(categories, lambda c: c.rlike(pattern)))
    some = lambda pattern: F.exists(categories, lambda c: c.rlike(pattern))
    born, died = _last_year(categories, fixed.BORN), _last_year(categories, fixed.DIED)
    foreign = F.size(F.filter(categories, lambda c: c.rlike(fixed.FOREIGN_CAT) & ~c.rlike(fixed.KOREAN_MARKER)))
    core, arts = count(fixed.CORE_TOPIC), count(fixed.ARTS_IDENTITY)
    return first_of(
        (died < PERIOD[0], F.lit("out_of_period_before")),
        (born > PERIOD[1], F.lit("out_of_period_after")),
        (born < 1820, F.lit("out_of_period_before")),
        (core == 0, F.lit("not_independence_topic")),
        (~some(fixed.STRONG_ACTIVIST) & (arts >= 3) & (arts > core), F.lit("arts_identity_dominant")),
        ((count(fixed.POST_LIBERATION) > 0) & ~some(fixed.ACTIVIST_CAT), F.lit("post_liberation_office_holder")),
        ((foreign >= 3) & ~some(fixed.FOREIGN_EXEMPT), F.lit("foreign_non_participant")),
    )


def target_type(question: Column) -> Column:
    """The type whose keyword stands furthest to the right; ties go to the type listed first. Null if there is none."""
    backwards = F.reverse(question)

    def last(word: str) -> Column:
        at = F.instr(backwards, word[::-1])
        return F.when(at > 0, F.length(question) - at - len(word) + 1).otherwise(-1)

    best = F.array(*(F.struct(F.greatest(*(last(w) for w in keys), F.lit(-1)).alias("at"), F.lit(-i).alias("first"), F.lit(kind).alias("type")) for i, (kind, keys) in enumerate(fixed.TYPE_KEYWORDS)))
    top = F.array_max(best)
    return F.when(top["at"] >= 0, top["type"])


def co_participant(question: Column) -> Column:
    return question.rlike(fixed.CO_PARTICIPANT) | question.rlike(fixed.CO_PARTICIPANT_REVERSED)


def target_relation(question: Column) -> Column:
    return F.when(question.rlike(fixed.FOUNDED_STEMS), "FOUNDED").otherwise("PARTICIPATED_IN")


def _any_of(question: Column, keywords: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (question.contains(k) for k in keywords))


def route(question: Column) -> Column:
    """path if anything asks for a path, else local."""
    chained = question.rlike(fixed.CHAINED_QUESTION)
    path = _any_of(question, fixed.PATH_KEYWORDS) | chained
    return F.when(path, "path").otherwise("local")


def edge_weight(confidence: Column, head: Column, tail: Column, sources: Column) -> Column:
    """Confidence, raised where an endpoint's own document is a source and where there are two or more."""
    own = F.array_contains(sources, head) | F.array_contains(sources, tail)
    return F.coalesce(confidence, F.lit(1.0)) * F.when(own, 1.3).otherwise(1.0) * F.when(F.size(sources) >= 2, 1.2).otherwise(1.0)


def seed_score(surface: Column, question: Column, kind: Column) -> Column:
    bonus = F.when(kind.isin("Person", "Organization", "Event"), 0.2).otherwise(0.0)
    share = F.least(F.lit(1.0), F.length(surface) / F.greatest(F.length(question), F.lit(1)) * 2)
    return F.round(F.least(F.lit(1.0), F.lit(0.7) + bonus + share * 0.1), 2)


def type_priority(kind: Column) -> Column:
    return F.when(kind == "Person", 3).when(kind == "Organization", 2).when(kind == "Event", 1).otherwise(0)


def answer_accuracy(answer: Column, expected: Column) -> Column:
    """1 if some expected answer is contained whatever the spaces, 0.5 if two neighbouring characters of one of three or more are, else 0."""
    squeezed = F.replace(answer, F.lit(" "), F.lit(""))
    whole = F.exists(expected, lambda e: F.contains(squeezed, F.replace(e, F.lit(" "), F.lit(""))))
    pairs = lambda e: F.transform(F.sequence(F.lit(1), F.greatest(F.length(e) - 1, F.lit(1))), lambda i: F.substring(e, i, F.lit(2)))
    part = F.exists(expected, lambda e: (F.length(stripped(e)) >= 3) & F.exists(pairs(stripped(e)), lambda p: F.contains(answer, p)))
    return F.when(F.size(expected) == 0, 0.0).when(whole, 1.0).when(part, 0.5).otherwise(0.0)
