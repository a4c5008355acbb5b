"""Predicates, levels of difficulty and what decides them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels: 0 hard, 1 easy, 2 easy at the second pass, and their fixed labels.
HARD, EASY, SECOND_EASY = 0, 1, 2
LABELS = {0: "困难", 1: "简单", 2: "二次简单"}


def present(c: Column) -> Column:
    return F.coalesce(F.trim(c.cast("string")) != "", F.lit(False))


def presence(fields: dict[str, Column]) -> Column:
    """struct of booleans: which fields have something in them."""
    return F.struct(*(present(c).alias(name) for name, c in fields.items()))


def missing_required(fields: dict[str, Column], required: list[str], either: tuple[str, ...]) -> Column:
    """Names of required fields that are empty, and the joined names of `either` if all of these are."""
    gaps = [F.when(~present(fields[r]), F.lit(r)) for r in required]
    gaps.append(F.when(~F.greatest(*(present(fields[e]) for e in either)), F.lit("|".join(either))))
    return F.array_compact(F.array(*gaps))


def bounded_number(c: Column, most: float = 100, decimals: int = 2) -> Column:
    """A number up to `most` with so many decimals at most."""
    return F.coalesce(c.rlike(rf"^\d+(\.\d{{1,{decimals}}})?$") & (c.try_cast("double") <= most), F.lit(False))


def level(c: Column) -> Column:
    """0, 1 or 2 of a number, a truth value or a label; null for anything else."""
    t = F.lower(F.trim(c.cast("string")))
    words = {"true": 0, "false": 1} | {label: n for n, label in LABELS.items()}
    named = F.try_element_at(F.create_map(*(F.lit(x) for pair in words.items() for x in pair)), t)
    number = t.try_cast("double")
    return F.coalesce(named, F.when(number.isin(0.0, 1.0, 2.0), number.cast("int")))


def level_label(c: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair)), c)


def final_level(first: Column, provided: Column, passed: Column, suffix_missed: Column, eligible: Column) -> Column:
    """The level after the second pass.

    first: the level before. provided, passed: arrays of the fields with a verdict and of those that passed.
    """
    hard_before = first.isNotNull() & (first != EASY)
    untouched = F.size(provided) == 0
    return (
        F.when(hard_before | F.coalesce(suffix_missed, F.lit(False)), HARD)
        .when(untouched, F.when(first == EASY, EASY).otherwise(HARD))
        .when(eligible & (first == EASY) & (F.size(F.array_except(provided, passed)) == 0), SECOND_EASY)
        .otherwise(EASY)
    )


def features(text: Column, tokens: dict[str, list[str]], strong: str, weak: str, fields: dict[str, Column]) -> Column:
    """Ordered array of struct(name, matched, note): special words by group, the standard's presence, missing fields."""
    found = lambda words: F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(F.upper(text), F.upper(w)))
    out = [F.struct(F.lit(f"special:{group}").alias("name"), (F.size(found(words)) > 0).alias("matched"), F.array_join(found(words), ",").alias("note")) for group, words in tokens.items()]
    state = F.when(text.rlike(strong), "strong").when(text.rlike(weak), "weak").otherwise("missing")
    out.append(F.struct(F.lit("standard").alias("name"), (state != "strong").alias("matched"), state.alias("note")))
    gaps = F.array_compact(F.array(*(F.when(~present(c), F.lit(name)) for name, c in fields.items())))
    out.append(F.struct(F.lit("structure").alias("name"), (F.size(gaps) > 0).alias("matched"), F.array_join(gaps, ",").alias("note")))
    return F.array(*out)


def reasons(found: Column) -> Column:
    """Notes of the matched features, each once, joined by ' | '."""
    hits = F.filter(found, lambda f: f["matched"] & (f["note"] != ""))
    return F.array_join(F.array_distinct(F.transform(hits, lambda f: f["note"])), " | ")


def suppressed_sets(labels: Column, rules: list[tuple[list[str], str, list[str]]]) -> Column:
    """Labels without those that rules (words, 'any' or 'all', dropped) take out; rules apply one after another."""
    for words, mode, dropped in rules:
        have = F.array(*map(F.lit, words))
        hit = F.arrays_overlap(labels, have) if mode == "any" else F.size(F.array_except(have, labels)) == 0
        labels = F.when(hit, F.array_except(labels, F.array(*map(F.lit, dropped)))).otherwise(labels)
    return labels


def demoted(rows: DataFrame, level_column: str, reasons_found: Column) -> DataFrame:
    """Level 2 becomes 1 where a low frequency gives a reason; such rows up from 1 go to review, with stage and reasons."""
    hit = (F.coalesce(reasons_found, F.lit("")) != "") & (F.col(level_column) > HARD)
    return rows.select(
        "*",
        F.when(hit, F.least(level_column, F.lit(EASY))).otherwise(F.col(level_column)).alias("final_level"),
        F.when(hit, "project_frequency").otherwise("second_pass").alias("decision_stage"),
        hit.alias("review"),
        F.when(hit, reasons_found).otherwise("").alias("reasons"),
    )


def interrupted(jobs: DataFrame, status: str, started: str, now: Column, active: tuple[str, ...]) -> DataFrame:
    """Jobs that were active get the status `interrupted` and the seconds since their start, not below 0."""
    was = F.col(status).isin(*active)
    seconds = F.greatest(F.lit(0).cast("long"), F.unix_timestamp(now) - F.unix_timestamp(started))
    return jobs.withColumn("seconds", F.when(was, seconds)).withColumn(status, F.when(was, "interrupted").otherwise(F.col(status)))
