"""Categorical encoding (E1-E3) and the row-wise OR of flags.

* E1 finds every column's vocabulary in **one** distributed job (unpivot +
  distinct with map-side combine; nulls are filtered before the shuffle).
  Only the vocabulary reaches the driver, as it names the columns.
* E2 turns the vocabulary into one ``select`` of ``when(col == v, 1)``
  expressions (pandas ``get_dummies(drop_first=True)`` semantics: the first
  value in sort order is dropped, null gives all zeros, non-encoded columns
  come first).
* E3 plans the slot roll-up on the *names* only (driver side, tiny) and
  applies it as one more ``select``; Catalyst collapses the projections, so
  the wide intermediate table is never materialised.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _q(c: str) -> str:
    return f"`{c}`"


# ---------------------------------------------------------------------------
# E1
# ---------------------------------------------------------------------------
def category_vocabulary_df(df: DataFrame, cols) -> DataFrame:
    """E1 as a DataFrame: (column_name, value) for every non-null value."""
    cols = list(cols)
    long = df.select(*[F.col(_q(c)).cast("string").alias(c) for c in cols]).unpivot(
        [], cols, "column_name", "value")
    return long.where(F.col("value").isNotNull()).distinct()


def category_vocabulary(df: DataFrame, cols, max_levels: int | None = None) -> dict[str, list[str]]:
    """{column: sorted distinct non-null values} in one job.

    The values become column names, so they are needed on the driver; a caller
    that wants an error rather than a very wide table sets ``max_levels``.  Free
    text does not belong in ``cols``: ``drop_columns_like(df, 'comment')`` leaves
    comment columns out."""
    cols = list(cols)
    if not cols:
        return {}
    long = category_vocabulary_df(df, cols)
    if max_levels is not None:
        wide = long.groupBy("column_name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_levels).first()
        if wide is not None:
            raise ValueError(f"column {wide['column_name']!r} has more than {max_levels} distinct values")
    vocab: dict[str, list[str]] = {c: [] for c in cols}
    for r in long.collect():
        vocab[r["column_name"]].append(r["value"])
    for vs in vocab.values():
        vs.sort()
    return vocab


# ---------------------------------------------------------------------------
# E2
# ---------------------------------------------------------------------------
@dataclass
class Encoding:
    """The plan of a one-hot encoding: output name -> (source column, value)."""
    flags: list[tuple[str, str, str]] = field(default_factory=list)   # (name, column, value)

    @property
    def names(self) -> list[str]:
        return [n for n, _, _ in self.flags]


def one_hot_plan(vocab: dict[str, list[str]], drop_first: bool = True, sep: str = "_") -> Encoding:
    enc = Encoding()
    for c, values in vocab.items():
        vs = values[1:] if drop_first else values
        enc.flags.extend((f"{c}{sep}{v}", c, v) for v in vs)
    return enc


def one_hot_drop_first(df: DataFrame, cols, vocab: dict | None = None, drop_first: bool = True,
                       keep: bool = True) -> DataFrame:
    """0/1 column per value except the first in sort order.

    ``keep=True`` carries the other columns in front (pandas order); the
    encoded source columns are replaced by their flags.
    """
    cols = list(cols)
    vocab = vocab if vocab is not None else category_vocabulary(df, cols)
    enc = one_hot_plan({c: vocab.get(c, []) for c in cols}, drop_first)
    front = [F.col(_q(c)) for c in df.columns if c not in cols] if keep else []
    flags = [F.when(F.col(_q(c)).cast("string") == F.lit(v), 1).otherwise(0).alias(n) for n, c, v in enc.flags]
    return df.select(*front, *flags)


# ---------------------------------------------------------------------------
# E3
# ---------------------------------------------------------------------------
def suffix_token(name: str) -> str | None:
    """F4 on a name: the text after the last underscore (None without one)."""
    _, underscore, tail = name.rpartition("_")
    return tail if underscore else None


def base_name(name: str, suffix: str) -> str:
    """F5 on a name: without its last two parts if these are a slot number and
    ``suffix``; unchanged otherwise."""
    if not name.endswith(f"_{suffix}"):
        return name
    stem, underscore, number = name.removesuffix(f"_{suffix}").rpartition("_")
    return stem if underscore and number.isdecimal() else name


def slot_stem(name: str) -> str:
    """A flag name without the first slot number that stands between two parts."""
    parts = name.split("_")
    for i in range(1, len(parts) - 1):
        if parts[i].isdecimal() and "_".join(parts[i + 1:]):
            return "_".join(parts[:i] + parts[i + 1:])
    return name


def rollup_plan(names, mode: str = "component") -> list[tuple[str, list[str]]]:
    """E3 plan: ordered [(output name, [source names])] from names alone.

    ``reference``: for each distinct suffix (first-seen order), OR every
    current name that contains ``_suffix`` anywhere (earlier outputs
    included) into ``base(first match) + '_' + suffix``, appended at the end;
    an output that is itself one of its sources is dropped with them.
    ``component``: OR the numbered slots of the same column stem and the
    same full value; other names pass through.
    """
    names = list(names)
    if mode == "reference":
        current: list[tuple[str, list[str]]] = [(n, [n]) for n in names]
        suffixes = []
        for n in names:
            s = suffix_token(n)
            if s is not None and s not in suffixes:
                suffixes.append(s)
        for s in suffixes:
            token = f"_{s}"
            matching = [(n, src) for n, src in current if token in n]
            if not matching:
                continue
            new = f"{base_name(matching[0][0], s)}_{s}"
            sources = []
            for _, src in matching:
                sources.extend(x for x in src if x not in sources)
            match_names = {n for n, _ in matching}
            current = [(n, src) for n, src in current if n not in match_names]
            if new not in match_names:
                current.append((new, sources))
        return current
    if mode == "component":
        out: dict[str, list[str]] = {}
        for n in names:
            out.setdefault(slot_stem(n), []).append(n)
        return list(out.items())
    raise ValueError(f"unknown mode {mode!r}")


def any_flag_expr(cols) -> F.Column:
    """A23 as an expression: 1 when any flag is 1 (null counts as 0)."""
    cols = list(cols)
    parts = [F.coalesce(F.col(_q(c)).cast("int"), F.lit(0)) for c in cols]
    return parts[0] if len(parts) == 1 else F.greatest(*parts)


def any_flag(df: DataFrame, cols, out: str) -> DataFrame:
    """Row-wise OR of flag columns as 0/1."""
    return df.withColumn(out, any_flag_expr(cols))


def slot_rollup(df: DataFrame, flag_cols=None, mode: str = "component", keep: bool = True) -> DataFrame:
    """Replace the flag block by its roll-up, in one ``select``."""
    flag_cols = list(flag_cols) if flag_cols is not None else list(df.columns)
    plan = rollup_plan(flag_cols, mode)
    front = [F.col(_q(c)) for c in df.columns if c not in flag_cols] if keep else []
    return df.select(*front, *[any_flag_expr(src).alias(n) for n, src in plan])
