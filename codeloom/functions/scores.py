"""Column expressions that score, classify and estimate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloom.schema import RESOLVED, TYPE_KINDS


def risk_level(depth: Column, confidence: Column) -> Column:
    return F.when((depth <= 1) & (confidence >= 0.8), "will_break").when((depth <= 2) & (confidence >= 0.5), "likely_affected").otherwise("possible")


def is_resolved(confidence: Column, candidates: Column) -> Column:
    return (confidence >= RESOLVED) & (F.size(candidates) == 0)


def in_scope(file: Column, prefixes: list[str]) -> Column:
    """Whether a file is under any of the prefixes; every file is where there are none."""
    out = F.lit(not prefixes)
    for p in prefixes:
        out = out | file.startswith(p)
    return out


def ratio(a: Column, b: Column) -> Column:
    """``a / b``, and 0 where ``b`` is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")


def blended(text_score: Column, rank_score: Column) -> Column:
    return 0.6 * text_score + 0.4 * rank_score


def cluster_weight(score: Column, kind: Column, owner: Column) -> Column:
    """Types count half as much again, and members of test classes half."""
    score = F.when(kind.isin(TYPE_KINDS), score * 1.5).otherwise(score)
    return F.when(F.substring_index(owner, ".", -1).endswith("Test"), score * 0.5).otherwise(score)


#: Fixed values of the Java language: primitive types, their boxes, and what each widens to.
BOXES = {"int": "Integer", "long": "Long", "short": "Short", "byte": "Byte", "char": "Character", "boolean": "Boolean", "float": "Float", "double": "Double"}
WIDER = {
    "byte": ["short", "int", "long", "float", "double"],
    "short": ["int", "long", "float", "double"],
    "char": ["int", "long", "float", "double"],
    "int": ["long", "float", "double"],
    "long": ["float", "double"],
    "float": ["double"],
}
EXACT, CONVERTS, SUBTYPE, NEUTRAL, MARGIN = 3, 2, 1, 0, 2


def argument_score(hint: Column, param: Column, is_subtype: Column) -> Column:
    """How well an argument's known type fits a parameter's; null where it can't. ``is_subtype``: of hint, or its box."""
    primitive = list(BOXES)
    boxes = F.create_map(*(F.lit(x) for kv in BOXES.items() for x in kv))
    wider = F.create_map(*(x for k, v in WIDER.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    up = (param == "Object") | is_subtype
    hint_primitive, param_primitive = hint.isin(primitive), param.isin(primitive)
    return (
        F.when(hint == "unknown", NEUTRAL)
        .when(hint == param, EXACT)
        .when(hint == "null", F.when(~param_primitive, NEUTRAL))
        .when(hint_primitive & param_primitive, F.when(F.coalesce(F.array_contains(wider[hint], param), F.lit(False)), CONVERTS))
        .when(hint_primitive, F.when(boxes[hint] == param, CONVERTS).when(up, SUBTYPE))
        .when(param_primitive, F.when(boxes[param] == hint, CONVERTS))
        .when(up, SUBTYPE)
        .otherwise(NEUTRAL)
    )


def gate_status(op: Column, value: Column, target: Column) -> Column:
    """PASS or FAIL of a measured value against a gate, SKIP where it wasn't measured."""
    ok = F.when(op == "<=", value <= target).when(op == ">=", value >= target).when(op == "==", value == target).when(op == "<", value < target).when(op == ">", value > target)
    return F.when(value.isNull() | ok.isNull(), "SKIP").when(ok, "PASS").otherwise("FAIL")
