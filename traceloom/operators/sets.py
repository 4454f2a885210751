"""Labelled sample sets: selection by specifications, set algebra, and checks."""
from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import PALETTE

#: One condition: value[field] in a query text; field defaults to code.
_TERM = re.compile(r"\s*(?:(?P<op>[&|!()])|(?P<value>[^\s&|!()\[\]]+)\s*(?:\[\s*(?P<field>\w+)\s*\])?)")


def parse_query(text: str) -> Column:
    """A condition over samples from value[field] terms with &, |, ! and parentheses; text compares without case."""
    at, tokens = 0, []
    while text[at:].strip():
        m = _TERM.match(text, at)
        if not m:
            raise ValueError(f"cannot read the query at {text[at:]!r}")
        tokens.append(m)
        at = m.end()
    place = 0

    def peek() -> str | None:
        return None if place >= len(tokens) else tokens[place]["op"] or "term"

    def either() -> Column:
        nonlocal place
        left = both()
        while peek() == "|":
            place += 1
            left = left | both()
        return left

    def both() -> Column:
        nonlocal place
        left = one()
        while peek() == "&":
            place += 1
            left = left & one()
        return left

    def one() -> Column:
        nonlocal place
        kind = peek()
        place += 1
        if kind == "!":
            return ~one()
        if kind == "(":
            inner = either()
            if peek() != ")":
                raise ValueError("a parenthesis is not closed")
            place += 1
            return inner
        if kind != "term":
            raise ValueError(f"a term is missing in {text!r}")
        m = tokens[place - 1]
        return F.lower(F.col(m["field"] or "code").cast("string")) == m["value"].lower()

    out = either()
    if place != len(tokens):
        raise ValueError(f"the query {text!r} does not end where it should")
    return out


def spec_condition(spec: dict) -> Column:
    """One specification: by query, codes (and batch), ids (or sample_ids), batch or batch_id, the first of these that it has, and by category, int1 and int2."""
    ids = spec.get("ids", spec.get("sample_ids"))
    same = lambda name, value: F.lower(F.col(name).cast("string")) == str(value).lower()
    if "query" in spec:
        out = parse_query(spec["query"])
    elif "codes" in spec:
        out = F.lower("code").isin(*[str(c).lower() for c in spec["codes"]])
        if "batch" in spec:
            out = out & same("batch", spec["batch"])
    elif ids is not None:
        out = F.col("sample_id").isin(*ids)
    elif "batch" in spec:
        out = same("batch", spec["batch"])
    elif "batch_id" in spec:
        out = F.col("batch_id") == spec["batch_id"]
    else:
        raise ValueError(f"a specification selects nothing: {spec}")
    for name in ("category", "int1", "int2"):
        if name in spec:
            out = out & (F.col(name) == spec[name])
    return out


def select_samples(samples: DataFrame, selector: dict | list, within: DataFrame | None = None, refine: Callable[[DataFrame, dict], DataFrame] | None = None) -> DataFrame:
    """(label, colour, sample_id) for a list of specifications (one set, '-') or a map from labels to such lists.

    The specifications of a label are united; within, if given, bounds all sets; refine filters the samples of each
    specification further. Without refine all labels come from one scan of samples.
    """
    labelled = {"-": selector} if isinstance(selector, list) else {k: v for k, v in selector.items() if k != "_:_"}
    colours = ["blue"] if isinstance(selector, list) else [PALETTE[i % len(PALETTE)] for i in range(len(labelled))]
    if refine is None:
        hits = F.array(*(F.when(reduce(lambda a, b: a | b, (spec_condition(s) for s in specs)), F.struct(F.lit(label).alias("label"), F.lit(colour).alias("colour"))) for (label, specs), colour in zip(labelled.items(), colours, strict=True)))
        out = samples.select("sample_id", F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("s")).select("s.label", "s.colour", "sample_id")
    else:
        parts = []
        for (label, specs), colour in zip(labelled.items(), colours, strict=True):
            own = reduce(lambda a, b: a.unionByName(b), (refine(samples.where(spec_condition(s)), s).select("sample_id") for s in specs)).distinct()
            parts.append(own.select(F.lit(label).alias("label"), F.lit(colour).alias("colour"), "sample_id"))
        out = reduce(lambda a, b: a.unionByName(b), parts)
    return out if within is None else restrict(out, within)


def restrict(sets: DataFrame, ids: DataFrame) -> DataFrame:
    return sets.join(ids.select("sample_id"), "sample_id", "left_semi")


def set_totals(sets: DataFrame) -> DataFrame:
    return sets.groupBy("label").agg(F.count("*").alias("n"))


def shared_samples(sets: DataFrame) -> DataFrame:
    """(sample_id, labels): samples that several sets hold, which sets must not."""
    return sets.groupBy("sample_id").agg(F.countDistinct("label").alias("labels")).where("labels > 1")


def require_disjoint(sets: DataFrame) -> DataFrame:
    if found := shared_samples(sets).limit(1).collect():
        raise ValueError(f"sample {found[0].sample_id} is in several sets")
    return sets


def symmetric_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that only one side has, with the side; both have the same columns."""
    both = left.distinct().withColumn("side", F.lit("left")).unionByName(right.distinct().withColumn("side", F.lit("right")))
    return both.groupBy(*left.columns).agg(F.min("side").alias("side"), F.count("*").alias("_n")).where("_n = 1").drop("_n")
