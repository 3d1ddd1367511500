"""Model formulas: ``y ~ a + b + a:b + I(x**2) + C(k)`` to columns of a design, and the same for new data.

Treatment coding: the first sorted level is the reference, names are
``k[T.level]``; without an intercept in the formula (``+ 0``) the first
category keeps all its levels, named ``k[level]``.
"""

from __future__ import annotations

import ast
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEXT = ("string", "boolean")
OPERATORS = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: lambda a, b: F.try_divide(a, b), ast.Pow: lambda a, b: F.pow(a, b)}
FUNCTIONS = {"log": F.log, "log1p": F.log1p, "exp": F.exp, "sqrt": F.sqrt, "abs": F.abs}


def arithmetic(node: ast.AST) -> Column:
    """A column from arithmetic on names, numbers and a few functions; anything else is an error."""
    if isinstance(node, ast.BinOp) and type(node.op) in OPERATORS:
        return OPERATORS[type(node.op)](arithmetic(node.left), arithmetic(node.right))
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
        return -arithmetic(node.operand)
    if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)):
        return F.lit(float(node.value))
    if isinstance(node, ast.Name):
        return F.col(f"`{node.id}`")
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and len(node.args) == 1:
        if node.func.id == "Q" and isinstance(node.args[0], ast.Constant):
            return F.col(f"`{node.args[0].value}`")
        f = FUNCTIONS.get(node.func.id.removeprefix("np."))
        if f or node.func.id == "I":
            return (f or (lambda x: x))(arithmetic(node.args[0]))
    raise ValueError(f"not arithmetic on columns: {ast.unparse(node)}")


def _terms(side: str, names: list[str]) -> tuple[list[tuple[str, ...]], bool]:
    """Terms, each a tuple of factors, in order; and whether an intercept is wanted."""
    out: list[tuple[str, ...]] = []
    intercept = True

    def walk(node: ast.AST, plus: bool = True) -> list[tuple[str, ...]]:
        nonlocal intercept
        if isinstance(node, ast.BinOp) and isinstance(node.op, (ast.Add, ast.Sub)):
            sign = isinstance(node.op, ast.Add)
            walk(node.left, plus)
            walk(node.right, plus == sign)
            return []
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            return walk(node.operand, not plus)
        if isinstance(node, ast.Constant) and node.value in (0, 1):
            intercept = bool(node.value) == plus
            return []
        for term in product(node):
            if plus and term not in out:
                out.append(term)
            if not plus and term in out:
                out.remove(term)
        return []

    def product(node: ast.AST) -> list[tuple[str, ...]]:
        if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Mult):  # a*b is a + b + a:b
            a, b = product(node.left), product(node.right)
            return [*a, *b, *[tuple(dict.fromkeys(x + y)) for x in a for y in b]]
        if isinstance(node, ast.BinOp) and isinstance(node.op, ast.MatMult):  # stands for a:b
            return [tuple(dict.fromkeys(x + y)) for x in product(node.left) for y in product(node.right)]
        if isinstance(node, ast.Name) and node.id == "__all__":
            return [(n if n.isidentifier() else f'Q("{n}")',) for n in names]
        return [(ast.unparse(node),)]

    text = side.strip()
    text = "__all__" + text[1:] if text.startswith(".") and not text[1:2].isdigit() else text
    text = text.replace("+ .", "+ __all__").replace(":", "@")
    walk(ast.parse(text, mode="eval").body)
    return out, intercept


@dataclass(frozen=True)
class Blueprint:
    """What a design needs of new data: terms, and the levels of each category that the formula uses."""

    outcome: str
    terms: tuple[tuple[str, ...], ...]
    levels: dict
    intercept: bool
    predictors: tuple[str, ...]

    def _factor(self, factor: str, full: bool) -> list[tuple[str, Column]]:
        name = _category(factor)
        if name in self.levels:
            tag = "" if full else "T."
            return [(f"{name}[{tag}{v}]", F.when(F.col(f"`{name}`").cast("string") == v, 1.0).otherwise(0.0)) for v in self.levels[name][0 if full else 1 :]]
        return [(factor, arithmetic(ast.parse(factor, mode="eval").body).cast("double"))]

    def columns(self) -> list[tuple[str, Column]]:
        out = [("Intercept", F.lit(1.0))] if self.intercept else []
        coded = self.intercept
        for term in self.terms:
            made: list[tuple[str, Column]] = [("", F.lit(1.0))]
            for factor in term:
                full = not coded and len(term) == 1 and _category(factor) in self.levels
                coded = coded or full
                made = [(f"{a}:{b}".lstrip(":"), x * y if a else y) for a, x in made for b, y in self._factor(factor, full)]
            out += made
        return out


def _category(factor: str) -> str:
    node = ast.parse(factor, mode="eval").body
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in ("C", "Q"):
        inner = node.args[0]
        return inner.value if isinstance(inner, ast.Constant) else ast.unparse(inner)
    return factor


def _design(df: DataFrame, plan: Blueprint, outcomes: bool) -> DataFrame:
    made = [c.alias(n) for n, c in plan.columns()]
    return df.select(*([arithmetic(ast.parse(plan.outcome, mode="eval").body).alias(plan.outcome)] if outcomes else []), *made)


def mold(formula: str, df: DataFrame, intercept: bool = True) -> tuple[DataFrame, Blueprint]:
    """Outcome and design columns, and the blueprint for ``forge``.

    Categories are the text columns of the formula and those in ``C()``; their
    levels come from one aggregate, which also counts nulls, an error in any
    column that the formula names.  ``intercept=False`` drops only the column
    ``Intercept``; the coding stays.
    """
    left, right = (s.strip() for s in formula.split("~", 1))
    types = dict(df.dtypes)
    named = {n.id for n in ast.walk(ast.parse(left, mode="eval")) if isinstance(n, ast.Name)}
    terms, wanted = _terms(right, [c for c in df.columns if c not in named])
    used, categories = [], []
    for factor in dict.fromkeys(f for t in terms for f in t):
        name = _category(factor)
        if name in types:
            used.append(name)
            if types[name] in TEXT or factor.startswith("C("):
                categories.append(name)
        else:
            used += [n.id for n in ast.walk(ast.parse(factor, mode="eval")) if isinstance(n, ast.Name) and n.id in types]
    used = list(dict.fromkeys(used))
    checked = [*used, *[n for n in named if n in types]]
    row = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"n_{i}") for i, c in enumerate(checked)], *[F.array_sort(F.collect_set(F.col(f"`{c}`").cast("string"))).alias(f"l_{i}") for i, c in enumerate(categories)]).first()
    missing = [c for i, c in enumerate(checked) if row[f"n_{i}"]]
    if missing:
        raise ValueError(f"nulls in {', '.join(missing)}")
    levels = {c: row[f"l_{i}"] for i, c in enumerate(categories)}
    plan = Blueprint(left, tuple(terms), levels, wanted, tuple(used))
    out = _design(df, plan, True)
    return (out if intercept else out.drop("Intercept")), plan


def forge(df: DataFrame, plan: Blueprint, outcomes: bool = False) -> DataFrame:
    """The same design for new data: a level unknown to the blueprint is an error, absent ones are columns of 0."""
    missing = [c for c in plan.predictors if c not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    if plan.levels:
        row = df.agg(*[F.max_by(F.col(f"`{c}`").cast("string"), F.when(~F.col(f"`{c}`").cast("string").isin(v), 1)).alias(c) for c, v in plan.levels.items()]).first().asDict()
        unseen = {c: v for c, v in row.items() if v is not None and v not in plan.levels[c]}
        if unseen:
            raise ValueError(f"unseen levels: {unseen}")
    return _design(df, plan, outcomes)
