"""Secret scans with multipart credential linking.

Strong patterns (assignments, access keys, long hex runs) are always reported.
Weak parts, which alone are ordinary text (an account name, a bare token, an
address), are reported only when a complementary part lies in their scope: an
interval join of the parts of a document on their scopes, run as nearest-part
windows so that no pairs are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, text_key

#: Patterns and least lengths of the strong kinds (fixed values), in their order.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, ACCESS_MIN = r"AKIA[A-Z0-9]+", 20
HEX, HEX_MIN = r"[0-9a-f]+", 24
ASSIGN_MIN = 6
#: Weak parts.
ACCOUNT = r"""([Aa][Cc][Cc][Ee][Ss][Ss]_?[Kk][Ee][Yy]_?[Ii][Dd]|[Cc][Ll][Ii][Ee][Nn][Tt]_?[Ii][Dd]|[Uu][Ss][Ee][Rr][Nn][Aa][Mm][Ee]|[Ll][Oo][Gg][Ii][Nn])["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]+)"""
BLOB, BLOB_MIN = r"[A-Za-z0-9+/_-]+", 32
ENDPOINT = r"""[a-z][a-z0-9+]*://[^\x00-\x20"'<>]+"""
KINDS = ["assign", "access", "hex", "account", "blob", "endpoint"]
ROLES = {"assign": "secret", "hex": "secret", "blob": "secret", "access": "identifier", "account": "identifier", "endpoint": "endpoint"}
STRONG = 3
#: Code points around a weak part in which its complement must lie.
SCOPE = 200
MASK = "[SECRET]"


def _matches(text: Column, kind: int, pattern: str, ok, maybe: Column) -> Column:
    """All leftmost non-overlapping matches as (kind, i, gap before it, length,
    good); texts where ``maybe`` is false are not searched."""
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(2 if "(" in pattern else 0))
    found = F.transform(F.arrays_zip(gaps.alias("gap"), whole.alias("m"), value.alias("v")),
                        lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), x["gap"].alias("gap"), F.length(x["m"]).alias("len"),
                                              ok(x["m"], x["v"]).alias("good")))
    none = F.array().cast("array<struct<kind:int,i:int,gap:int,len:int,good:boolean>>")
    return F.when(maybe, found).otherwise(none)


def _parts(text: Column) -> Column:
    low = F.lower(text)
    has = lambda *words: F.greatest(*[F.contains(low, F.lit(w)) for w in (*words, words[0])])
    long_enough = lambda n: (lambda m, v: F.length(m) >= n)                                      # noqa: E731
    # runs of one class of at least n characters are the maximal runs that are long enough
    hexes, blobs, keys = HEX.replace("+", f"{{{HEX_MIN},}}"), BLOB[:-1] + f"{{{BLOB_MIN},}}", ACCESS.replace("+", f"{{{ACCESS_MIN - 4},}}")
    return F.concat(
        _matches(text, 0, ASSIGN, lambda m, v: F.length(v) >= ASSIGN_MIN, has("password", "passwd", "secret", "token", "apikey", "api_key")),
        _matches(text, 1, keys, long_enough(ACCESS_MIN), F.contains(text, F.lit("AKIA"))),
        _matches(text, 2, hexes, long_enough(HEX_MIN), text.rlike(hexes)),
        _matches(text, 3, ACCOUNT, lambda m, v: F.length(v) >= 3, has("key", "client", "username", "login")),
        _matches(text, 4, blobs, lambda m, v: m.rlike("[0-9]") & m.rlike("[a-zA-Z]"), text.rlike(blobs)),
        _matches(text, 5, ENDPOINT, lambda m, v: F.length(m) >= 8, F.contains(text, F.lit("://"))))


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Secrets of every row of ``docs`` (doc_id, text).

    Columns: doc_id, text_hash, n_assign, n_access, n_hex, base_sha256, spans,
    span_list (array of struct start, kind, end).  Positions are code points,
    end exclusive.  A weak part that overlaps a strong one is not reported.  A
    weak identifier needs a secret in its scope, a weak secret an identifier or
    endpoint, an endpoint an identifier or secret.

    Null or empty text: no spans.  Repeated rows stay, one result row each.
    Null doc_id is an id like any other.  An empty table gives no rows; other
    columns are ignored."""
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.struct(F.lit(-1).alias("kind"), F.lit(0).alias("i"), F.lit(0).alias("gap"), F.lit(0).alias("len"), F.lit(False).alias("good"))
    # the part of kind -1 carries the document itself
    p = docs.select("doc_id", text_key(F.col("text")).alias("text_hash"), F.inline(F.concat(F.array(none), _parts(text))))
    p = p.repartition("doc_id", "text_hash")
    same = ["doc_id", "text_hash"]
    run = Window.partitionBy(*same, "kind").orderBy("i").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    doc = Window.partitionBy(*same)
    copies = F.count(F.when(F.col("kind") == -1, 1)).over(doc)
    p = p.withColumn("copies", copies)
    # each repeated row brings its matches again: sums over them are exact multiples
    p = p.withColumn("end", (F.sum(F.col("gap") + F.col("len")).over(run) / F.col("copies")).cast("int"))
    p = p.where((F.col("kind") == -1) | F.col("good")).dropDuplicates([*same, "kind", "i"]) \
        .withColumn("start", F.col("end") - F.col("len"))

    order = doc.orderBy("start", "kind")
    back = order.rowsBetween(Window.unboundedPreceding, -1)
    ahead = order.rowsBetween(1, Window.unboundedFollowing)
    is_a = lambda role: F.col("kind").isin([k for k, n in enumerate(KINDS) if ROLES[n] == role])
    near = lambda role: F.coalesce(F.col("start") - F.max(F.when(is_a(role), F.col("end"))).over(back) <= scope, F.lit(False)) \
        | F.coalesce(F.min(F.when(is_a(role), F.col("start"))).over(ahead) - F.col("end") <= scope, F.lit(False))                  # noqa: E731
    strong = F.col("kind").between(0, STRONG - 1)
    overlaps = F.coalesce(F.max(F.when(strong, F.col("end"))).over(back) > F.col("start"), F.lit(False)) \
        | F.coalesce(F.min(F.when(strong, F.col("start"))).over(ahead) < F.col("end"), F.lit(False))
    p = p.select("*", near("secret").alias("by_secret"), near("identifier").alias("by_identifier"), near("endpoint").alias("by_endpoint"), overlaps.alias("overlaps"))
    linked = F.when(is_a("identifier"), F.col("by_secret")).when(is_a("secret"), F.col("by_identifier") | F.col("by_endpoint")) \
        .when(is_a("endpoint"), F.col("by_identifier") | F.col("by_secret"))
    reported = strong | (F.col("kind").between(STRONG, len(KINDS) - 1) & ~F.col("overlaps") & linked)

    span = F.struct(F.col("start"), F.col("kind"), F.col("end"))
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"], s["end"])), ",")
    per_doc = p.groupBy(*same).agg(
        *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{KINDS[k]}") for k in range(STRONG)],
        F.max("copies").alias("copies"), F.array_sort(F.collect_list(F.when(reported, span))).alias("span_list"))
    base = F.filter("span_list", lambda s: s["kind"] < STRONG)
    return per_doc.select(*same, *[f"n_{KINDS[k]}" for k in range(STRONG)], F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
                          listed(F.col("span_list")).alias("spans"), "span_list",
                          F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy")).drop("copy")


def redact(docs: DataFrame, scope: int = SCOPE, mask: str = MASK) -> DataFrame:
    """``docs`` with every reported span replaced by ``mask`` (overlapping spans
    by one).  All rows and columns stay; null text stays null.  ``n_chars``,
    where the table has it, is counted anew for changed texts."""
    found = scan(docs, scope).where(F.size("span_list") > 0).dropDuplicates(["doc_id", "text_hash"]) \
        .select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("span_list").alias("__spans"))
    on = docs["doc_id"].eqNullSafe(found["__id"]) & text_key(docs["text"]).eqNullSafe(found["__hash"])
    d = docs.join(found, on, "left")
    text = F.col("text")
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    # spans lie in order of start: keep what lies between the furthest end so far and the next start
    step = lambda a, s: F.when(s["end"] <= a["at"], a).otherwise(F.struct(                                             # noqa: E731
        F.concat(a["out"], F.when(s["start"] >= a["at"], F.concat(F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit(mask)))
                 .otherwise("")).alias("out"), s["end"].alias("at")))
    new = F.aggregate("__spans", zero, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    changed = F.col("__spans").isNotNull()
    d = d.withColumn("text", F.when(changed, new).otherwise(text))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        d = d.withColumn("n_chars", F.when(changed, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return d.select(*docs.columns)


def op7_secret_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def oracle(docs: str = "documents") -> str:
    """Plain form: positions by splitting, links by comparing all parts of a document."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"                        # noqa: E731
    kinds = [(ASSIGN, 2, f"length(v) >= {ASSIGN_MIN}"), (ACCESS, 0, f"length(m) >= {ACCESS_MIN}"), (HEX, 0, f"length(m) >= {HEX_MIN}"),
             (ACCOUNT, 2, "length(v) >= 3"), (BLOB, 0, f"length(m) >= {BLOB_MIN} AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[a-zA-Z]')"),
             (ENDPOINT, 0, "length(m) >= 8")]
    parts = " UNION ALL ".join(f"""
      SELECT doc_id, {k} AS kind, start, start + length(m) AS stop FROM (
        SELECT doc_id, m, v, sum(gap) OVER w + sum(length(m)) OVER w - length(m) AS start FROM (
          SELECT doc_id, unnest(range(0, len(ms))) AS i, unnest(list_transform(gaps[1:len(ms)], lambda g: length(g))) AS gap, unnest(ms) AS m, unnest(vs) AS v FROM (
            SELECT doc_id, regexp_split_to_array(text, {quote(p)}) AS gaps, regexp_extract_all(text, {quote(p)}, 0) AS ms, regexp_extract_all(text, {quote(p)}, {g}) AS vs FROM t))
        WINDOW w AS (PARTITION BY doc_id ORDER BY i)) WHERE {good}""" for k, (p, g, good) in enumerate(kinds))
    role = "CASE WHEN {0}.kind IN (0, 2, 4) THEN 1 WHEN {0}.kind IN (1, 3) THEN 2 ELSE 3 END"
    name = "['assign','access','hex','account','blob','endpoint'][kind + 1] || ':' || start || ':' || stop"
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM {docs}),
p AS MATERIALIZED ({parts}),
kept AS (SELECT DISTINCT a.* FROM p a WHERE a.kind < {STRONG} OR (
  NOT EXISTS (SELECT 1 FROM p b WHERE b.doc_id = a.doc_id AND b.kind < {STRONG} AND b.start < a.stop AND b.stop > a.start)
  AND EXISTS (SELECT 1 FROM p b WHERE b.doc_id = a.doc_id AND b.start - a.stop <= {SCOPE} AND a.start - b.stop <= {SCOPE}
    AND ({role.format('a')}, {role.format('b')}) IN ((2, 1), (1, 2), (1, 3), (3, 1), (3, 2))))),
f AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  coalesce(string_agg({name}, ',' ORDER BY start, kind) FILTER (kind < {STRONG}), '') AS base, string_agg({name}, ',' ORDER BY start, kind) AS spans
  FROM kept GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN f USING (doc_id)"""


ORACLE = {"op7_secret_linking": oracle()}
QUERIES = {"op7_secret_linking": op7_secret_linking}
