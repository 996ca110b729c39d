"""Content models over tables: groups of child rows matched against a particle in their order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treequill.types.regex import literal


class Model:
    """A content model of names: element, sequence, choice, and occurrences."""

    def __init__(self, build) -> None:
        self.build = build

    @staticmethod
    def element(name: str) -> Model:
        return Model(lambda chars: chars(name))

    @staticmethod
    def sequence(*parts: Model) -> Model:
        return Model(lambda chars: "".join(p.build(chars) for p in parts))

    @staticmethod
    def choice(*parts: Model) -> Model:
        return Model(lambda chars: "(?:" + "|".join(p.build(chars) for p in parts) + ")")

    def occurs(self, least: int, most: int | None) -> Model:
        return Model(lambda chars: f"(?:{self.build(chars)}){{{least},{'' if most is None else most}}}")


def unmatched(children: DataFrame, parent: str, order: Sequence[str], name: str, model: Model) -> DataFrame:
    """(parent, word, code) of the parents whose children's names, in order, don't match the model; names outside it match nothing.

    A parent's names are gathered as one character each, so the gathered text is
    as long as the parent has children.
    """
    known: dict[str, str] = {}

    def chars(value: str) -> str:
        return known.setdefault(value, chr(0xE000 + len(known)))

    pattern = f"^(?:{model.build(chars)})$"
    symbol = F.lit(chr(0xF8FF))
    for value, c in known.items():
        symbol = F.when(F.col(name) == value, F.lit(c)).otherwise(symbol)
    words = children.groupBy(parent).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, symbol.alias("_s")))), lambda x: x["_s"]), "").alias("_word"), F.count(F.lit(1)).alias("n"))
    return words.where(~F.expr(f"_word rlike {literal(pattern)}")).select(parent, "n", F.lit("cvc-complex-type.2.4").alias("code"))
