"""Rule predicates: expression trees compiled to Columns, with PASS, FAIL and SKIPPED outcomes."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The operators of an expression and the numbers of their arguments (None: any, from one).
ARITY = {
    "and": None, "or": None, "not": 1, "implies": 2, "==": 2, "!=": 2, "<": 2, "<=": 2, ">": 2, ">=": 2, "+": 2, "-": 2,
    "days_between": 2, "add_years": 2, "add_days": 2, "if": 3,
}


class PredicateError(ValueError):
    """An expression that can't be compiled: unknown operator, wrong number of arguments or wrong sorts."""


@dataclass
class _Term:
    column: Column
    sort: str
    inputs: set[str] = field(default_factory=set)


def compile_expression(tree: dict | str, sorts: dict[str, str], choices: dict[str, str] | None = None) -> _Term:
    """The Column of an expression over columns of these sorts (bool, number, date, string).

    Leaves: {"var": name}, {"const": value, "sort": sort}; nodes: {"op": name, "args": [...]}; {"choose": parameter,
    "options": {reading: tree}} takes the branch of the chosen reading and visits no other. Wrong sorts raise, they
    never cast; numbers are decimals, so 0.1 + 0.2 == 0.3.
    """
    node = json.loads(tree) if isinstance(tree, str) else tree
    if "var" in node:
        name = node["var"]
        if name not in sorts:
            raise PredicateError(f"type: unknown input {name}")
        c = F.col(name).cast("decimal(38,9)") if sorts[name] == "number" else F.col(name)
        return _Term(c, sorts[name], {name})
    if "const" in node:
        v, sort = node["const"], node.get("sort") or ("bool" if isinstance(node["const"], bool) else "number" if isinstance(node["const"], (int, float)) else "string")
        c = F.lit(str(v)).cast("decimal(38,9)") if sort == "number" else F.lit(v).cast("date") if sort == "date" else F.lit(v)
        return _Term(c, sort)
    if "choose" in node:
        reading = (choices or {}).get(node["choose"])
        if reading not in node["options"]:
            raise PredicateError(f"missing: no reading of {node['choose']}")
        return compile_expression(node["options"][reading], sorts, choices)
    op, args = node["op"], [compile_expression(a, sorts, choices) for a in node["args"]]
    if op not in ARITY or (ARITY[op] is not None and len(args) != ARITY[op]) or not args:
        raise PredicateError(f"type: {op} of {len(args)}")
    s = [a.sort for a in args]
    c = [a.column for a in args]
    inputs = set().union(*[a.inputs for a in args])

    def want(*kinds: str) -> None:
        if s != list(kinds):
            raise PredicateError(f"type: {op} of {', '.join(s)}")

    if op in ("and", "or", "not", "implies"):
        want(*["bool"] * len(s))
        if op == "not":
            out = ~c[0]
        elif op == "implies":
            out = ~c[0] | c[1]
        else:
            out = c[0]
            for x in c[1:]:
                out = out & x if op == "and" else out | x
        return _Term(out, "bool", inputs)
    if op in ("==", "!="):
        if s[0] != s[1]:
            raise PredicateError(f"type: {op} of {', '.join(s)}")
        return _Term(c[0] == c[1] if op == "==" else c[0] != c[1], "bool", inputs)
    if op in ("<", "<=", ">", ">="):
        if s[0] != s[1] or s[0] not in ("number", "date"):
            raise PredicateError(f"type: {op} of {', '.join(s)}")
        return _Term({"<": c[0] < c[1], "<=": c[0] <= c[1], ">": c[0] > c[1], ">=": c[0] >= c[1]}[op], "bool", inputs)
    if op in ("+", "-"):
        want("number", "number")
        return _Term((c[0] + c[1] if op == "+" else c[0] - c[1]).cast("decimal(38,9)"), "number", inputs)
    if op == "days_between":
        want("date", "date")
        return _Term(F.datediff(c[1], c[0]).cast("decimal(38,9)"), "number", inputs)
    if op in ("add_years", "add_days"):
        want("date", "number")
        n = c[1].cast("int")
        return _Term(F.add_months(c[0], n * 12) if op == "add_years" else F.date_add(c[0], n), "date", inputs)
    if s[0] != "bool" or s[1] != s[2]:
        raise PredicateError(f"type: if of {', '.join(s)}")
    return _Term(F.when(c[0], c[1]).otherwise(c[2]), s[1], inputs)


def evaluate(rows: DataFrame, predicate_id: str, tree: dict | str, inputs: dict[str, str], error: str, keep: list[str], choices: dict[str, str] | None = None) -> DataFrame:
    """(keep, predicate_id, outcome, error_code, missing): PASS, FAIL with its error code, or SKIPPED.

    A row lacking any input the expression visits is SKIPPED, even where the rest would settle it ("or true"); missing
    then names all inputs of the predicate that are null, visited or not. An expression of wrong sorts skips every row
    with its reason.
    """
    kind = "array<string>"
    try:
        term = compile_expression(tree, inputs, choices)
        if term.sort != "bool":
            raise PredicateError(f"type: {term.sort}")
    except PredicateError as e:
        return rows.select(*keep, F.lit(predicate_id).alias("predicate_id"), F.lit("SKIPPED").alias("outcome"), F.lit(None).cast("string").alias("error_code"), F.array(F.lit(str(e))).alias("missing"))
    lacks = F.lit(False)
    for name in sorted(term.inputs):
        lacks = lacks | F.col(name).isNull()
    missing = F.array_compact(F.array(*[F.when(F.col(n).isNull(), F.lit(n)) for n in sorted(inputs)]).cast(kind))
    outcome = F.when(lacks, "SKIPPED").when(term.column, "PASS").otherwise("FAIL")
    return rows.select(
        *keep, F.lit(predicate_id).alias("predicate_id"), outcome.alias("outcome"), F.when(outcome == "FAIL", error).alias("error_code"),
        F.when(outcome == "SKIPPED", missing).otherwise(F.array().cast(kind)).alias("missing"),
    )


def run_all(rows: DataFrame, registry: list[dict], keep: list[str]) -> DataFrame:
    """All predicates of a registry (predicate_id, tree, inputs, error, status) that are APPROVED, over the same rows."""
    parts = [evaluate(rows, p["predicate_id"], p["tree"], p["inputs"], p["error"], keep, p.get("choices")) for p in registry if p.get("status", "APPROVED") == "APPROVED"]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
