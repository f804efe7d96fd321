"""Catalog filters (F1-F14): a FilterSpec becomes one boolean Column that Catalyst pushes below explodes and joins."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

STATUSES = ("complete", "partial", "none")
TEXT_FIELDS = ("title", "paper_title", "source_study_id", "publication_pmid", "source", "species", "cell_type", "notes")


@dataclass(frozen=True)
class FilterSpec:
    """Shared filter arguments. Percent and underscore in texts act as wildcards; array filters are case-sensitive."""

    query: str | None = None
    year: int | None = None
    cell_type: str | None = None
    organelle: str | None = None
    organelle_pair: str | None = None
    modality: str | None = None
    metric_family: str | None = None
    comparator_class: str | None = None
    modality_family: str | None = None
    public_data_status: str | None = None
    public_data_only: bool = False
    include_borderline: bool = False


def contains_pattern(c: Column, text: str) -> Column:
    return F.coalesce(c.ilike(f"%{text}%"), F.lit(False))


def condition(spec: FilterSpec) -> Column:
    """The conjunction of all given filters; an unknown public status raises ValueError."""
    if spec.public_data_status is not None and spec.public_data_status not in STATUSES:
        raise ValueError(f"unknown public data status {spec.public_data_status!r}")
    parts: list[Column] = [F.col("included_status").isin(*(("included", "borderline") if spec.include_borderline else ("included",)))]
    if spec.query:
        parts.append(reduce(or_, [contains_pattern(F.col(f), spec.query) for f in TEXT_FIELDS]))
    if spec.year is not None:
        parts.append(F.col("year") == spec.year)
    for field in ("cell_type", "modality", "modality_family", "comparator_class"):
        if value := getattr(spec, field):
            parts.append(contains_pattern(F.col(field), value))
    for field, column in (("organelle", "organelles"), ("organelle_pair", "organelle_pairs"), ("metric_family", "metric_families")):
        if value := getattr(spec, field):
            parts.append(F.array_contains(column, value))
    if spec.public_data_status:
        parts.append(F.col("public_data_status") == spec.public_data_status)
    if spec.public_data_only:
        parts.append(F.col("public_data_status") != "none")
    return reduce(and_, parts)


def contains_ci(array: str, value: str) -> Column:
    """membership ignoring case."""
    return F.exists(array, lambda x: F.lower(x) == value.lower())


def overlaps(array: str, values: Sequence[str]) -> Column:
    """any of the values; none for an empty list."""
    return F.arrays_overlap(F.col(array), F.array(*[F.lit(v) for v in values])) if values else F.lit(False)


def precedent_text(query: str | None) -> Column:
    """substring of the joined fields, ignoring case."""
    q = (query or "").strip().lower()
    fields = ["dataset_id", "source_study_id", "publication_pmid", "paper_title", "source", "cell_type", "species", "modality", "comparator_class", "comparator_detail"]
    parts = [F.coalesce(F.col(f), F.lit("")) for f in fields] + [F.array_join("organelles", " "), F.array_join("metric_families", " ")]
    return F.contains(F.lower(F.concat_ws(" ", *parts)), F.lit(q)) if q else F.lit(True)


def public_state(state: str | None) -> Column:
    """records of one public state; any for none. Other states than the three are an error."""
    if state and state not in STATUSES:
        raise ValueError(f"unknown public state {state!r}")
    return F.col("public_data_status") == state if state else F.lit(True)


def all_tokens(text: Column, query: str) -> Column:
    """every white-space token of the query is a substring."""
    tokens = query.split()
    return reduce(and_, [F.instr(text, t) > 0 for t in tokens], F.lit(True))


def token_prefixes(text: Column, query: str) -> Column:
    """every alphanumeric run of two or more characters begins a token of the text."""
    words = F.split(F.lower(text), "[^\\p{L}\\p{N}]+")
    begins = lambda run: F.exists(words, lambda w: F.startswith(w, F.lit(run)))
    return reduce(and_, [begins(r.lower()) for r in re.findall(r"[^\W_]+", query) if len(r) >= 2], F.lit(True))
