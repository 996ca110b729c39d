"""Identity constraints: unique, key, keyref over tuples, and ID / IDREF over node tables.

Tuples come from a table's columns or from selector and field paths below scope
nodes. Duplicates are one aggregation by (scope, fields), missing targets one
anti join: no constraint compares tuples pair by pair.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treequill.functions.values import fresh, one, typed_items
from treequill.plans.compiler import Compiler, Static
from treequill.plans.lineage import cut
from treequill.plans.within import Within, found_in
from treequill.xpath import ast as A
from treequill.xpath.errors import XPathError
from treequill.xpath.parser import parse

DUPLICATE, MISSING, INCOMPLETE = "cvc-identity-constraint.4.2.2", "cvc-identity-constraint.4.3", "cvc-identity-constraint.4.2.1"


def _all_present(fields: Sequence[str]) -> Column:
    out = F.lit(True)
    for f in fields:
        out = out & F.col(f).isNotNull()
    return out


def unique(tuples: DataFrame, fields: Sequence[str], scope: Sequence[str] = (), code: str = "cvc-identity-constraint.4.1") -> DataFrame:
    """(scope, fields, n, code) of complete tuples that occur ``n`` > 1 times in a scope."""
    counted = tuples.where(_all_present(fields)).groupBy(*scope, *fields).agg(F.count(F.lit(1)).alias("n"))
    return counted.where("n > 1").withColumn("code", F.lit(code))


def key(tuples: DataFrame, fields: Sequence[str], scope: Sequence[str] = ()) -> DataFrame:
    """As ``unique``, for incomplete tuples too (absent equals absent), and with a row for each incomplete tuple."""
    counted = tuples.groupBy(*scope, *fields).agg(F.count(F.lit(1)).alias("n"))
    twice = counted.where("n > 1").withColumn("code", F.lit(DUPLICATE))
    holes = counted.where(~_all_present(fields)).withColumn("code", F.lit(INCOMPLETE))
    return twice.unionByName(holes)


def keyref(tuples: DataFrame, fields: Sequence[str], targets: DataFrame, target_fields: Sequence[str], scope: Sequence[str] = ()) -> DataFrame:
    """(scope, fields, n, code) of complete tuples that no target tuple of the scope equals."""
    wanted = tuples.where(_all_present(fields)).groupBy(*scope, *fields).agg(F.count(F.lit(1)).alias("n"))
    there = targets.where(_all_present(target_fields)).select(*[F.col(c).alias(f"_s{i}") for i, c in enumerate(scope)], *[F.col(c).alias(f"_t{i}") for i, c in enumerate(target_fields)]).distinct()
    met = F.lit(True)
    for i, c in enumerate(scope):
        met = met & (F.col(c) == F.col(f"_s{i}"))
    for i, c in enumerate(fields):
        met = met & (F.col(c) == F.col(f"_t{i}"))
    return wanted.join(there, met, "left_anti").withColumn("code", F.lit(MISSING))


# Over node tables.


@dataclass(frozen=True)
class Constraint:
    """A constraint of an element declaration; ``scope`` is the path of the declaring elements."""

    kind: str
    name: str
    scope: str
    selector: str
    fields: tuple[str, ...]
    refer: str | None = None


_STEP = r"(?:child::)?(?:\*|[\w.\-]+(?::(?:\*|[\w.\-]+))?)|\."
_SELECTOR = re.compile(rf"(?:\.//)?(?:{_STEP})(?:/(?:{_STEP}))*$")
_FIELD = re.compile(rf"(?:\.//)?(?:(?:{_STEP})(?:/(?:{_STEP}))*(?:/(?:@|attribute::)(?:\*|[\w.\-:*]+))?|(?:@|attribute::)(?:\*|[\w.\-:*]+))$")


def restricted(path: str, field: bool) -> A.Expr:
    """A selector or field path: XPathError if it leaves the restricted subset."""
    for branch in path.split("|"):
        if not (_FIELD if field else _SELECTOR).match(re.sub(r"\s+", "", branch)):
            raise XPathError("src-identity-constraint", f"{path!r} is outside the paths of identity constraints")
    return parse(path)


def tuples(spark, static: Static, constraints: Sequence[Constraint]) -> list[DataFrame]:
    """(doc, scope, pre, f0, f1, …) of the nodes that each constraint selects; fields are typed values as text, null if absent.

    Constraints of one scope are read in one pass over each document.
    """
    compiler, scopes, out = Compiler(static), {}, []
    for c in constraints:
        scope = parse(c.scope)
        hops = [compiler.hop(s) for s in compiler.fused(scope.steps)] if isinstance(scope, A.Path) and scope.absolute else [None]
        paths = [compiler.branches(restricted(p, i > 0)) for i, p in enumerate((c.selector, *c.fields))]
        if None in hops or None in paths:
            raise XPathError("src-identity-constraint", "the scope must be nodes" if None in hops else "the selector must find elements")
        asked = scopes.setdefault(tuple(hops), Within(fresh("tq_scopes"), tuple(hops)))  # type: ignore[arg-type]
        member = asked.member("tuples", tuple(paths))
        values = ", ".join(f"{one(typed_items(f't.f{i}')).sql} AS f{i}" for i in range(len(c.fields)))
        out.append(f"SELECT doc, scope, t.pre AS pre, {values} FROM (SELECT doc, pre AS scope, explode({member}) AS t FROM `{asked.view}`)")
    for asked in scopes.values():
        cut(found_in(spark.table(static.nodes), asked, {"pre", *asked.members.values()})).createOrReplaceTempView(asked.view)
    return [spark.sql(sql) for sql in out]


def violations(spark, static: Static, constraints: Sequence[Constraint]) -> DataFrame:
    """(doc, pre, code, message) of what breaks the constraints; ``pre`` is the scope node."""
    found = None
    by_name = {c.name: c for c in constraints}
    read = dict(zip(constraints, tuples(spark, static, constraints), strict=True))
    for c in constraints:
        fields = [f"f{i}" for i in range(len(c.fields))]
        own = read[c]
        if c.kind == "keyref":
            target = by_name.get(c.refer or "")
            if target is None:
                raise XPathError("src-identity-constraint", f"{c.name} refers to no key")
            bad = keyref(own, fields, read[target], fields, ["doc", "scope"])
        else:
            bad = key(own, fields, ["doc", "scope"]) if c.kind == "key" else unique(own, fields, ["doc", "scope"])
        rows = bad.select("doc", F.col("scope").alias("pre"), "code", F.concat(F.lit(f"{c.name}: "), F.concat_ws(", ", *fields)).alias("message"))
        found = rows if found is None else found.union(rows)
    if found is None:
        raise ValueError("no constraints")
    return found


def id_violations(typed: DataFrame) -> DataFrame:
    """(doc, pre, code, message) from (doc, pre, kind, value) of ID and IDREF values: duplicates and dangling references."""
    ids = typed.where("kind = 'ID'").groupBy("doc", F.trim("value").alias("id")).agg(F.min("pre").alias("pre"), F.count(F.lit(1)).alias("n"))
    twice = ids.where("n > 1").select("doc", "pre", F.lit("cvc-id.2").alias("code"), F.concat(F.lit("ID "), "id").alias("message"))
    refs = typed.where("kind in ('IDREF', 'IDREFS')").select("doc", "pre", F.explode(F.split(F.trim(F.regexp_replace("value", r"[ \t\n\r]+", " ")), " ")).alias("ref"))
    known = ids.select(F.col("doc").alias("_d"), F.col("id").alias("_i"))
    lost = refs.join(known, (F.col("doc") == F.col("_d")) & (F.col("ref") == F.col("_i")), "left_anti")
    return twice.union(lost.select("doc", "pre", F.lit("cvc-id.1").alias("code"), F.concat(F.lit("IDREF "), "ref").alias("message")))
