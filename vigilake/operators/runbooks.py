"""Matching runbooks to incidents and chat messages to runbook steps."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilake.constants import (
    COMMAND_WORD_PATTERN,
    FENCE_PATTERN,
    GENERIC_COMMAND_WORDS,
    STEP_MIN_TOKENS,
)

try:
    import ahocorasick
except ImportError:  # the words are then looked for one by one
    ahocorasick = None

GRAM = 3
AUTOMATON_WORDS = 200_000


@lru_cache(maxsize=10_000)
def compiled(pattern: str) -> re.Pattern | None:
    """The pattern as the matching compiles it, or None if it is not one."""
    try:
        return re.compile(pattern, re.IGNORECASE)
    except (re.error, OverflowError, RecursionError):
        return None


def folded(text: str) -> str:
    """One spelling for all letters that match each other without regard to case."""
    plain = unicodedata.normalize("NFD", text.casefold())
    return plain.replace("\u0307", "").replace("\u0131", "i")


def required_words(pattern: str) -> list[str]:
    """Literals of at least `GRAM` characters one of which every match holds; [] if none is known.

    Read from the parsed pattern: runs of plain characters that no branch or repetition
    can leave out. A choice needs a literal of each of its branches.
    """
    if compiled(pattern) is None:
        return []

    def of(items) -> list[str]:
        options, run = [], []

        def close() -> None:
            if len(run) >= GRAM:
                options.append(["".join(run)])
            run.clear()

        for op, value in items:
            name = str(op)
            if name == "LITERAL" and value < 128:
                run.append(chr(value).lower())
                continue
            close()
            if name == "SUBPATTERN":
                options.append(of(value[3]))
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] >= 1:
                options.append(of(value[2]))
            elif name == "ATOMIC_GROUP":
                options.append(of(value))
            elif name == "BRANCH":
                branches = [of(branch) for branch in value[1]]
                options.append([w for words in branches for w in words] if all(branches) else [])
        close()
        return max((o for o in options if o), key=lambda o: min(map(len, o)), default=[])

    return sorted(set(of(re._parser.parse(pattern, re.IGNORECASE))))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _required(patterns: pd.Series) -> pd.Series:
    return patterns.map(lambda p: required_words(p) or [""])


@F.pandas_udf(T.StringType())
def _folded(names: pd.Series) -> pd.Series:
    return names.map(folded)


@F.pandas_udf(T.BooleanType())
def _is_pattern(patterns: pd.Series) -> pd.Series:
    return patterns.map(lambda p: p is None or compiled(p) is not None).astype(bool)


@F.pandas_udf(T.BooleanType())
def _found_in(names: pd.Series, patterns: pd.Series, services: pd.Series, filters: pd.Series) -> pd.Series:
    """Whether the pattern matches the name and the filter, if there is one, the service."""

    def one(name, pattern, service, wanted) -> bool:
        if compiled(pattern).search(name) is None:
            return False
        return wanted is None or service is not None and compiled(wanted).search(service) is not None

    return pd.Series([one(*row) for row in zip(names, patterns, services, filters)], dtype=bool)


def pattern_problems(runbooks: DataFrame) -> DataFrame:
    """(id, problem) of runbooks whose alert pattern or service filter does not compile."""
    columns = ["alert_pattern", "service_filter"]
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("pattern")) for c in columns]))
    return runbooks.select("id", each.alias("p")).where(~_is_pattern(F.col("p.pattern"))).select(
        "id", F.concat("p.column", F.lit(" is not valid regex")).alias("problem"))


def match_runbooks(incidents: DataFrame, runbooks: DataFrame) -> DataFrame:
    """Best runbook per incident: id, runbook_id, score, matched_on.

    `incidents` has id, root_signal, alertname, severity, service; `runbooks`
    has id, position (anything that sorts, such as the file name), alert_pattern,
    (a runbook with a pattern that does not compile matches nothing, see `pattern_problems`),
    severity_filter, service_filter. The root signal decides; the alert name is only asked when nothing matched it.

    Incidents are reduced to their distinct situations first. What literal a pattern
    needs is read from the pattern; situations and patterns meet on three characters of
    it, so a pattern is only tried where it may match. A pattern without such a literal
    is tried on every situation, as it has to be. The plan is the same for any number of runbooks.
    """
    fields = ["name", "severity", "service"]
    asked = (
        incidents.select(F.col("root_signal").alias("name"), "severity", "service")
        .union(incidents.select("alertname", "severity", "service"))
        .where(F.coalesce("name", F.lit("")) != "").distinct()
    )
    usable = runbooks.where(
        F.col("alert_pattern").isNotNull() & _is_pattern("alert_pattern") & _is_pattern("service_filter"))
    score = 1 + F.col("severity_filter").isNotNull().cast("int") + 2 * F.col("service_filter").isNotNull().cast("int")
    words = usable.select(
        F.struct((-score).alias("neg_score"), "position", F.col("id").alias("runbook_id")).alias("found"),
        "alert_pattern", "severity_filter", "service_filter", F.explode(_required("alert_pattern")).alias("word"),
    ).withColumn("gram", F.substring("word", 1, GRAM))
    text = asked.withColumn("folded", _folded("name"))
    places = F.sequence(F.lit(1), F.greatest(F.length("folded") - (GRAM - 1), F.lit(1)))
    grams = F.array_distinct(F.transform(places, lambda at: F.substring(F.col("folded"), at, F.lit(GRAM))))
    near = text.withColumn("gram", F.explode(F.array_append(grams, F.lit(""))))
    wanted = F.col("severity_filter").isNull() | (F.col("severity_filter") == F.col("severity"))
    tried = near.join(words, "gram").where(wanted & F.col("folded").contains(F.col("word"))).dropDuplicates([*fields, "found"])
    best = tried.where(_found_in("name", "alert_pattern", "service", "service_filter")).groupBy(*fields).agg(
        F.min("found").alias("found"))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))

    def answers(prefix):
        return best.select(*[F.col(f).alias(f"{prefix}_{f}") for f in fields],
                           F.col("found").alias(f"{prefix}_found"))

    def joined(left, name, prefix):
        on = (F.col(name) == F.col(f"{prefix}_name")) & same("severity", f"{prefix}_severity") & same(
            "service", f"{prefix}_service"
        )
        return left.join(answers(prefix), on, "left")

    both = joined(joined(incidents.select("id", "root_signal", "alertname", "severity", "service"),
                         "root_signal", "r"), "alertname", "a")
    by_root = F.col("r_found").isNotNull()
    found = F.coalesce("r_found", "a_found")
    return both.where(found.isNotNull()).select(
        "id", found["runbook_id"].alias("runbook_id"), (-found["neg_score"]).alias("score"),
        F.when(by_root, F.col("root_signal")).otherwise(F.col("alertname")).alias("matched_on"),
        F.when(by_root, "root_signal").otherwise("alertname").alias("source"),
    )


def command_tokens(body: Column) -> Column:
    """Distinct telling words of a step's fenced command blocks."""
    blocks = F.regexp_extract_all(body, F.lit(FENCE_PATTERN), F.lit(1))
    words = F.flatten(
        F.transform(blocks, lambda b: F.regexp_extract_all(b, F.lit(COMMAND_WORD_PATTERN), F.lit(0)))
    )
    lowered = F.transform(words, F.lower)
    return F.array_distinct(F.filter(lowered, lambda w: ~w.isin(*GENERIC_COMMAND_WORDS)))


def detect_steps(
    messages: DataFrame, steps: DataFrame, min_tokens: int = STEP_MIN_TOKENS
) -> DataFrame:
    """The step each message executes: most command words contained, earliest step on a tie.

    `messages` has runbook_id and text; `steps` has runbook_id, step_id, position,
    body. The words of a runbook are one automaton, which reads a message once, however many
    words there are. Runbooks are configuration: up to `AUTOMATON_WORDS` words, counted
    first, go to every task; beyond, a runbook's words travel with its messages and are looked for one by one.
    """
    tokens = steps.select("runbook_id", "position", "step_id", command_tokens(F.col("body")).alias("tokens")).where(
        F.size("tokens") > 0)
    total = tokens.agg(F.sum(F.size("tokens"))).first()[0] or 0
    if ahocorasick is None or total > AUTOMATON_WORDS:
        return _steps_by_words(messages, tokens, min_tokens)
    books: dict = {}
    for row in tokens.collect():  # bounded by the count above
        books.setdefault(row.runbook_id, []).append(((-row.position, row.step_id), row.tokens))
    shared = messages.sparkSession.sparkContext.broadcast(books)
    automata: dict = {}

    @F.pandas_udf(f"step_id {tokens.schema['step_id'].dataType.simpleString()}, hits int")
    def executed(runbook_ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        def one(book, text):
            if text is None or book not in shared.value:
                return None, None
            if book not in automata:
                automata[book] = _automaton(shared.value[book])
            found = {steps for _, steps in automata[book].iter(text)}
            hits = Counter(step for _, steps in found for step in steps)
            enough = [(n, shared.value[book][step][0]) for step, n in hits.items() if n >= min_tokens]
            if not enough:
                return None, None
            n, (_, step_id) = max(enough)
            return step_id, n

        return pd.DataFrame([one(b, t) for b, t in zip(runbook_ids, texts)], columns=["step_id", "hits"]).astype({"hits": "Int32"})

    known = messages.join(tokens.select("runbook_id").distinct(), "runbook_id", "left_semi")
    # generated rather than projected, so that the filter on it cannot run it twice
    tried = known.select(*messages.columns, F.explode(F.array(executed("runbook_id", F.lower("text")))).alias("_best"))
    return tried.where(F.col("_best.step_id").isNotNull()).select(*messages.columns, "_best.step_id", "_best.hits")


def _automaton(steps: list):
    """Finds every word of the steps; a word carries its number and the steps that have it."""
    of: dict[str, list[int]] = {}
    for number, (_, words) in enumerate(steps):
        for word in words:
            of.setdefault(word, []).append(number)
    found = ahocorasick.Automaton()
    for number, (word, numbers) in enumerate(of.items()):
        found.add_word(word, (number, tuple(numbers)))
    found.make_automaton()
    return found


def _steps_by_words(messages: DataFrame, tokens: DataFrame, min_tokens: int) -> DataFrame:
    """The same without an automaton: a runbook's steps travel as one array beside its messages."""
    books = tokens.groupBy("runbook_id").agg(
        F.array_sort(F.collect_list(F.struct("position", "step_id", "tokens"))).alias("_steps")
    ).withColumn("_words", F.array_distinct(F.flatten(F.col("_steps.tokens"))))

    def said_words(said):
        return F.filter("_words", lambda word: said.contains(word))

    def best(present):
        hits = F.transform(
            "_steps",
            lambda s: F.struct(
                F.size(F.array_intersect(s["tokens"], present)).alias("hits"),
                (-s["position"]).alias("order"), s["step_id"].alias("step_id"),
            ),
        )
        return F.array_max(F.filter(hits, lambda h: h["hits"] >= min_tokens))

    found = F.transform(F.transform(F.array(F.lower("text")), said_words), best)[0]
    tried = messages.join(books, "runbook_id").select(
        *messages.columns, F.explode_outer(F.array(found)).alias("_best")
    )
    return tried.where(F.col("_best").isNotNull()).select(
        *messages.columns, "_best.step_id", "_best.hits"
    )


def step_signals(
    detected: DataFrame, reactions: DataFrame, commands: DataFrame, runbooks: DataFrame
) -> DataFrame:
    """Executed steps from messages, reactions and commands: one row per incident and step.

    Each input has incident_id, runbook_id, step_id, source_message_ts and
    observed_at. Steps the runbook does not declare are dropped.
    """
    columns = ["incident_id", "runbook_id", "step_id", "source_message_ts", "observed_at"]
    tagged = [
        rows.select(*columns, F.lit(source).alias("detected_by"))
        for rows, source in (
            (detected, "command_match"), (reactions, "reaction"), (commands, "slash_command"))
    ]
    every = tagged[0].unionByName(tagged[1]).unionByName(tagged[2])
    declared = runbooks.select(
        F.col("id").alias("runbook_id"), F.explode("step_ids").alias("step_id")
    ).distinct()
    valid = every.join(declared, ["runbook_id", "step_id"], "left_semi")
    rest = F.struct("runbook_id", "detected_by", "source_message_ts", "observed_at")
    order = F.struct("observed_at", "detected_by")
    return valid.groupBy("incident_id", "step_id").agg(F.min_by(rest, order).alias("r")).select(
        "incident_id", "step_id", "r.*"
    )
