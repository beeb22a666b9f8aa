"""Named columns that annotate reads: written, read, removed, and derived from design tables.

An annotation table has one row per read (``read_id``) and a column for each name: texts are labels,
numbers are scores. A design maps combinations of labels (keys) to further columns; these are
materialised and follow their keys. Every function returns the new table; nothing is changed in place.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.relations import derive_design, last_wins

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
#: A label column has at most so many different labels.
MOST_LABELS = 65_535


@dataclass(frozen=True)
class Annotations:
    """The table, and for each design its keys, values and rows."""

    table: DataFrame
    designs: Mapping[str, tuple[tuple[str, ...], tuple[str, ...], DataFrame]] = field(default_factory=dict)

    @property
    def names(self) -> list[str]:
        return [c for c in self.table.columns if c != "read_id"]

    def labels(self) -> list[str]:
        return [c for c, t in self.table.dtypes if t == "string" and c != "read_id"]

    def scores(self) -> list[str]:
        return [c for c, t in self.table.dtypes if t in ("float", "double")]

    def derived(self) -> dict[str, str]:
        """Each column that a design gives, with the design's name."""
        return {v: name for name, (_, values, _) in self.designs.items() for v in values}


def empty(reads: DataFrame) -> Annotations:
    """No annotation yet, for all reads."""
    return Annotations(reads.select("read_id").distinct())


def write_columns(own: Annotations, new: DataFrame, columns: Sequence[str], order: Sequence[Column | str] = ()) -> Annotations:
    """The annotations with ``columns`` of ``new`` set or replaced, in one pass.

    Ids that the archive lacks are ignored, of repeated ids the last in ``order`` wins, an empty label
    is none. Refused: names that are no identifiers or that a design gives, and scores that are NaN.
    Designs with a changed key are derived anew.
    """
    derived = own.derived()
    for c in columns:
        if not _NAME.fullmatch(c) or c == "read_id":
            raise ValueError(f"not a name for a column: {c}")
        if c in derived:
            raise ValueError(f"{c} is given by the design {derived[c]}")
    kinds = dict(new.dtypes)
    values = []
    for c in columns:
        if kinds[c] == "string":
            values.append(F.nullif(F.col(c), F.lit("")).alias(c))
        elif kinds[c] in ("float", "double"):
            values.append(F.when(F.isnan(c), F.raise_error(F.lit(f"{c} has a score that is no number")).cast(kinds[c])).otherwise(F.col(c)).alias(c))
        else:
            raise ValueError(f"{c} is neither a label nor a score")
    rows = last_wins(new.select("read_id", F.struct(*values).alias("_v"), *[F.col(o).alias(f"_o{i}") if isinstance(o, str) else o.alias(f"_o{i}") for i, o in enumerate(order)]), "read_id", "_v", [*[f"_o{i}" for i in range(len(order))], "_v"])
    table = own.table.drop(*columns).join(rows.select("read_id", "_v.*"), "read_id", "left")
    for keys, given, design in own.designs.values():
        if set(keys) & set(columns):
            table = derive_design(table.drop(*given), design, keys)
    return Annotations(table, own.designs)


def write_annotation(own: Annotations, new: DataFrame, column: str, order: Sequence[Column | str] = ()) -> Annotations:
    """One label column."""
    if dict(new.dtypes).get(column) != "string":
        raise ValueError(f"{column} is no label")
    return write_columns(own, new, [column], order)


def read_columns(own: Annotations, columns: Sequence[str] = ()) -> DataFrame:
    """read_id and the columns, labels and scores mixed; unknown names are an error, no names give ids only."""
    unknown = [c for c in columns if c not in own.names]
    if unknown:
        raise KeyError(f"no annotation {', '.join(unknown)}")
    return own.table.select("read_id", *columns)


def _only(found: list[str], name: str | None, kind: str) -> str:
    if name is None and len(found) != 1:
        raise ValueError(f"name one of the {len(found)} {kind}s")
    name = found[0] if name is None else name
    if name not in found:
        raise KeyError(f"no {kind} {name}")
    return name


def read_annotation(own: Annotations, name: str | None = None) -> DataFrame:
    """(read_id, label) of the reads that have one; the name may be left out if there is one label column."""
    name = _only(own.labels(), name, "label")
    return own.table.select("read_id", name).where(F.col(name).isNotNull())


def read_score(own: Annotations, name: str | None = None) -> DataFrame:
    """(read_id, score) of the reads that have one; the name may be left out if there is one score column."""
    name = _only(own.scores(), name, "score")
    return own.table.select("read_id", name).where(F.col(name).isNotNull())


def remove_annotation(own: Annotations, name: str) -> Annotations:
    """The annotations without a column; one that a design has as key or value is refused."""
    if name not in own.names:
        raise KeyError(f"no annotation {name}")
    for design, (keys, values, _) in own.designs.items():
        if name in (*keys, *values):
            raise ValueError(f"{name} belongs to the design {design}")
    return Annotations(own.table.drop(name), own.designs)


def write_design(own: Annotations, name: str, design: DataFrame, keys: Sequence[str]) -> Annotations:
    """The annotations with the design's value columns; its keys must be label columns, its values must be new or its own."""
    missing = [k for k in keys if k not in own.labels()]
    values = tuple(c for c in design.columns if c not in keys)
    if missing or not keys or not values:
        raise ValueError(f"a design needs existing label columns as keys, and values (missing: {', '.join(missing) or 'none'})")
    before = remove_design(own, name) if name in own.designs else own
    clash = [v for v in values if v in before.names]
    if clash:
        raise ValueError(f"already a column: {', '.join(clash)}")
    return Annotations(derive_design(before.table, design, list(keys)), {**before.designs, name: (tuple(keys), values, design)})


def remove_design(own: Annotations, name: str) -> Annotations:
    """The annotations without a design and the columns it gave; its keys stay."""
    if name not in own.designs:
        raise KeyError(f"no design {name}")
    return Annotations(own.table.drop(*own.designs[name][1]), {k: v for k, v in own.designs.items() if k != name})


def read_design(own: Annotations, name: str) -> DataFrame:
    if name not in own.designs:
        raise KeyError(f"no design {name}")
    return own.designs[name][2]


def merge_annotations(inputs: Sequence[DataFrame], column: str) -> DataFrame:
    """One label per read; a later input overrides an earlier one where it has a label."""
    stacked = None
    for i, df in enumerate(inputs):
        part = df.select("read_id", F.nullif(F.col(column), F.lit("")).alias(column), F.lit(i).alias("_input")).where(F.col(column).isNotNull())
        stacked = part if stacked is None else stacked.unionByName(part)
    return last_wins(stacked, "read_id", column, ["_input", column])


def distinct_labels(table: DataFrame, column: str, most: int = MOST_LABELS) -> DataFrame:
    """The different labels, sorted; more than ``most`` are an error."""
    found = table.select(column).where(F.coalesce(F.col(column), F.lit("")) != "").distinct()
    if found.limit(most + 1).count() > most:
        raise ValueError(f"{column} has more than {most} labels")
    return found.orderBy(column)


def describe(own: Annotations) -> DataFrame:
    """One row per label (name, label, n) and per score column (name, n, least, most)."""
    none = F.lit(None).cast("double")
    parts = [own.table.where(F.col(c).isNotNull()).groupBy(F.lit(c).alias("name"), F.col(c).alias("label")).agg(F.count("*").alias("n")).select("name", "label", "n", none.alias("least"), none.alias("most")) for c in own.labels()]
    parts += [own.table.agg(F.count(c).alias("n"), F.min(c).cast("double").alias("least"), F.max(c).cast("double").alias("most")).select(F.lit(c).alias("name"), F.lit(None).cast("string").alias("label"), "n", "least", "most") for c in own.scores()]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found


def with_annotations(reads: DataFrame, own: Annotations, columns: Sequence[str], decimals: int = 4) -> DataFrame:
    """Text columns of annotations after those of a view: a missing label or score is empty, scores have ``decimals``."""
    scores = own.scores()
    text = [F.coalesce(F.format_string(f"%.{decimals}f", F.col(c).cast("double")) if c in scores else F.col(c), F.lit("")).alias(c) for c in columns]
    shown = own.table.select("read_id", *[F.when(F.col(c).isNotNull(), t).otherwise("").alias(c) for c, t in zip(columns, text)])
    return reads.join(shown, "read_id", "left").fillna("", list(columns))
