"""The two named feature pipelines.

``production_features`` follows the batch training job: time features, a
drop-first one-hot of the condition block, the reference-mode slot roll-up,
meta columns dropped, remaining text columns one-hot encoded, names
sanitised.  ``explore_features`` follows the notebook: empty slots and
comments dropped, slot nulls filled with 'yes', IQR filters on registration
year then odometer, the same encoding, and the rolled-up flags re-encoded as
text (so their names gain ``_1``); names are not sanitised.

Both return ``FeatureFrame``: one lazy DataFrame (key + features + target,
planned as a single projection over the input) and the ordered feature list.
The only jobs they run are the small metadata jobs (vocabularies, quartiles).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gearlens import schema as S
from gearlens.functions.timefx import time_features
from gearlens.operators import encode as EN
from gearlens.operators import prep as P


@dataclass
class FeatureFrame:
    df: DataFrame
    features: list[str]
    target: str = S.TARGET
    key: str = S.KEY


def _q(c: str) -> str:
    return f"`{c}`"


def _is_text(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, T.StringType)


def _encode_block(df: DataFrame, cat_cols: list[str], mode: str, vocab: dict | None = None) -> tuple[list, list[str]]:
    """E1 + E2 + E3 on the condition block -> ([(name, expr)], names).

    An all-null column has no vocabulary and passes through unencoded (as in
    pandas, where it is numeric); it still takes part in the roll-up plan.
    """
    vocab = vocab if vocab is not None else EN.category_vocabulary(df, cat_cols)
    passthrough = [c for c in cat_cols if not vocab.get(c)]
    enc = EN.one_hot_plan({c: vocab[c] for c in cat_cols if vocab.get(c)}, drop_first=True)
    flag_expr = {c: F.lit(None).cast("int") for c in passthrough}
    for name, c, v in enc.flags:
        flag_expr[name] = F.when(F.col(_q(c)).cast("string") == F.lit(v), 1).otherwise(0)
    order = passthrough + enc.names
    plan = EN.rollup_plan(order, mode)

    def any_of(srcs):
        parts = [F.coalesce(flag_expr[s], F.lit(0)) for s in srcs]
        return parts[0] if len(parts) == 1 else F.greatest(*parts)

    return [(name, any_of(srcs)) for name, srcs in plan], [n for n, _ in plan]


def production_features(df: DataFrame, rollup_mode: str = "reference", sanitize: bool = True) -> FeatureFrame:
    """The training job's preprocessing (see module doc)."""
    base = time_features(df)
    cat_cols = P.columns_like(base, S.SLOT_PREFIX)
    rest = [c for c in base.columns if c not in cat_cols and c not in S.META_DROP_COLUMNS]
    if S.TARGET not in rest:
        raise ValueError(f"target column {S.TARGET!r} not found")
    feats_plain = [c for c in rest if c != S.TARGET]
    text_cols = [c for c in feats_plain if _is_text(base, c)]
    # one vocabulary job for the condition block and the other text columns
    vocab = EN.category_vocabulary(base, cat_cols + text_cols)
    block, _ = _encode_block(base, cat_cols, rollup_mode, {c: vocab[c] for c in cat_cols})
    block = [(n, e) for n, e in block if n not in S.META_DROP_COLUMNS]
    dummies = EN.one_hot_plan({c: vocab[c] for c in text_cols}, drop_first=True)
    numeric = [c for c in feats_plain if c not in text_cols]

    cols = [(c, F.col(_q(c))) for c in numeric] + block
    cols += [(n, F.when(F.col(_q(c)) == F.lit(v), 1).otherwise(0)) for n, c, v in dummies.flags]
    names = [n for n, _ in cols]
    if sanitize:
        names = [P.sanitize_name(n) for n in names]
        if len(set(names)) != len(names):
            raise ValueError("feature names collide after sanitising")
    key = [F.col(S.KEY)] if S.KEY in base.columns else []
    out = base.select(*key, *[e.alias(n) for n, (_, e) in zip(names, cols)], F.col(S.TARGET))
    return FeatureFrame(out, names)


def explore_clean(df: DataFrame, persist: bool = False) -> DataFrame:
    """The notebook's cleaning: empty slots and comments dropped, slot nulls
    filled with 'yes', time features, IQR filters on year then odometer.

    The filters and the encoding read the table in several small jobs.  Left
    lazy, each job is pruned to the columns it needs (the year quartiles never
    touch the slot pivot), which is cheaper than caching the wide table;
    ``persist=True`` is for inputs whose upstream is expensive for every
    column.  Persisted blocks are recomputed from lineage if an executor is lost.
    """
    d = P.drop_columns(df, S.EMPTY_SLOT_COLUMNS)
    d = P.drop_columns_like(d, S.COMMENT_MARK)
    # a missing rating stays missing: the fill value is a text
    d = P.fill_slots(d, [c for c in P.columns_like(d, "engineTransmission") if c != S.TARGET], S.SLOT_FILL_VALUE)
    d = time_features(d)
    if persist:
        d = d.persist(StorageLevel.MEMORY_AND_DISK)
    d = P.iqr_filter(d, S.REG_YEAR)
    d = P.iqr_filter(d, S.ODOMETER)
    return d


def explore_features(df: DataFrame, rollup_mode: str = "reference", cleaned: DataFrame | None = None) -> FeatureFrame:
    """The notebook's modelling table (see module doc)."""
    base = cleaned if cleaned is not None else explore_clean(df)
    cat_cols = P.columns_like(base, S.SLOT_PREFIX)
    block, block_names = _encode_block(base, cat_cols, rollup_mode)
    rest = [c for c in base.columns if c not in cat_cols]
    # stage 1: rolled-up flags become text columns next to the other columns
    stage = base.select(*[F.col(_q(c)) for c in rest],
                        *[e.cast("string").alias(n) for n, e in block])
    keep = [c for c in stage.columns if c not in S.META_DROP_COLUMNS or c == S.KEY]
    stage = stage.select(*[F.col(_q(c)) for c in keep])
    feats_plain = [c for c in stage.columns if c not in (S.TARGET, S.KEY)]
    text_cols = [c for c in feats_plain if _is_text(stage, c)]
    vocab = EN.category_vocabulary(stage, text_cols)
    dummies = EN.one_hot_plan({c: vocab[c] for c in text_cols}, drop_first=True)
    numeric = [c for c in feats_plain if c not in text_cols]
    cols = [(c, F.col(_q(c))) for c in numeric]
    cols += [(n, F.when(F.col(_q(c)) == F.lit(v), 1).otherwise(0)) for n, c, v in dummies.flags]
    key = [F.col(S.KEY)] if S.KEY in stage.columns else []
    out = stage.select(*key, *[e.alias(n) for n, e in cols], F.col(S.TARGET).cast("double").alias(S.TARGET))
    return FeatureFrame(out, [n for n, _ in cols])


def anova_table(df: DataFrame, rollup_mode: str = "reference") -> tuple[DataFrame, list[str]]:
    """The notebook's ANOVA input: rolled-up flags as text with 'Unknown'
    for nulls, next to the target."""
    base = explore_clean(df)
    cat_cols = P.columns_like(base, S.SLOT_PREFIX)
    block, names = _encode_block(base, cat_cols, rollup_mode)
    out = base.select(F.col(S.TARGET).cast("double").alias(S.TARGET),
                      *[F.coalesce(e.cast("string"), F.lit(S.UNKNOWN_VALUE)).alias(n) for n, e in block])
    return out, names
