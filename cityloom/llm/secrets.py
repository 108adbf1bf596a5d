"""Secret scan with multipart credential linking, in DataFrame functions alone.

Every text gives parts: strong ones (an assigned secret, an access key, a long hex run) that count by themselves, and
weak ones (a login, a token-like word, an endpoint) that mean little alone. Parts of a scope, the text between two
blank lines, are joined by interval: two parts meet where the gap between them is at most ``reach`` code points. A weak
identifier is reported where it meets a secret, a weak secret where it meets an identifier, an endpoint where it meets
both. The join is a sweep: along each scope the furthest end so far and the nearest start to come of every role are
running values, so a crowded scope costs its sorting, never its pairs.

Offsets are code points, ends exclusive. Null texts count as empty. A text without parts has no spans. Rows that repeat
get the same result each. Rows of a null id are scanned like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import packed, unpacked

#: The base kinds, in their order.
ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = {"assign": ASSIGN, "access": "AKIA[A-Z0-9]{16,}", "hex": "[0-9a-f]{24,}"}
LEAST_VALUE = 6
WEAK = {
    "ident": r"""\b([uU][sS][eE][rR]([nN][aA][mM][eE])?|[lL][oO][gG][iI][nN]|[cC][lL][iI][eE][nN][tT]_?[iI][dD]|[aA][cC][cC][oO][uU][nN][tT])["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@+-]{3,}""",
    "secret": r"""[A-Za-z0-9+/_-]{20,}""",
    "endpoint": r"""[a-z][a-z0-9+]*://[A-Za-z0-9._~:/?#@!$&'()*+,;=%-]{4,}""",
    "break": r"""\n[ \t\r]*\n""",
}
KINDS = [*BASE, *WEAK]
ROLE = {"assign": "secret", "access": "ident", "hex": "secret", "ident": "ident", "secret": "secret", "endpoint": "endpoint"}
REACH = 200


def _parts(text: Column, kind: str) -> Column:
    """Matches of one kind in their order: how far each lies behind the one before, and the text it covers."""
    pattern = (BASE | WEAK)[kind]
    both = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, hit: F.struct(F.length(gap).alias("gap"), hit.alias("hit")))
    number = F.lit(KINDS.index(kind))
    return F.filter(F.transform(both, lambda x, i: F.struct(number.alias("kind"), i.alias("nth"), x["gap"].alias("gap"), x["hit"].alias("hit"))), lambda x: x["hit"].isNotNull())


def row_key(id: str, text: str) -> Column:
    """Names a row by what it holds, so that every attempt at a task gives it the same name."""
    return F.unhex(F.sha2(F.concat(F.coalesce(F.col(id).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(F.col(text), F.lit(""))), 256))


def find(docs: DataFrame, reach: int = REACH, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, key, rows, spans`` for every different row; a span has ``start, kind, end`` and ``base``. ``rows`` says how often the row occurs."""
    number = {k: KINDS.index(k) for k in KINDS}
    whole = F.coalesce(F.col(text), F.lit(""))
    self_row = F.array(F.struct(F.lit(-1).alias("kind"), F.lit(0).alias("nth"), F.lit(0).alias("gap"), F.lit("").alias("hit")))
    parts = docs.select(F.col(id).alias("doc_id"), row_key(id, text).alias("key"), F.explode(F.concat(self_row, *[_parts(whole, k) for k in KINDS])).alias("part"))
    hit, kind = F.col("part.hit"), F.col("part.kind")
    mixed = hit.rlike("[0-9]") & hit.rlike("[a-z]") & hit.rlike("[A-Z]")
    counts = (F.when(kind == number["assign"], F.length(F.regexp_extract(hit, ASSIGN, 2)) >= LEAST_VALUE)
              .when(kind == number["secret"], mixed).otherwise(True))
    slim = parts.select("doc_id", "key", kind.alias("kind"), F.col("part.nth").alias("nth"), F.col("part.gap").alias("gap"), F.length(hit).alias("size"), counts.alias("counts"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    once = slim.repartition(n, "key").groupBy("key", "doc_id", "kind", "nth", "gap", "size", "counts").agg(F.count("*").alias("rows"))

    along = Window.partitionBy("key", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    placed = once.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(along)).withColumn("start", F.col("end") - F.col("size")).where("counts")
    base = F.col("kind").between(0, len(BASE) - 1)
    before = Window.partitionBy("key").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    scoped = placed.withColumn("scope", F.sum(F.when(F.col("kind") == number["break"], 1).otherwise(0)).over(before)).withColumn(
        "covered", F.coalesce(F.max(F.when(base, F.col("end"))).over(before) >= F.col("end"), F.lit(False)))
    up = Window.partitionBy("key", "scope").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("key", "scope").orderBy(F.col("start").desc()).rangeBetween(Window.unboundedPreceding, 0)

    def meets(role: str) -> Column:
        mine = F.col("kind").isin([number[k] for k, r in ROLE.items() if r == role])
        reached = F.max(F.when(mine, F.col("end"))).over(up) >= F.col("start") - reach
        coming = F.min(F.when(mine, F.col("start"))).over(down) <= F.col("end") + reach
        return F.coalesce(reached, F.lit(False)) | F.coalesce(coming, F.lit(False))

    linked = (F.when(F.col("kind") == number["ident"], meets("secret")).when(F.col("kind") == number["secret"], meets("ident"))
              .when(F.col("kind") == number["endpoint"], meets("ident") & meets("secret")).otherwise(False))
    reported = scoped.withColumn("reported", base | (linked & ~F.col("covered")))
    span = F.struct(F.col("start").cast("bigint").alias("start"), F.col("kind").alias("kind"), F.col("end").cast("bigint").alias("end"), base.alias("base"))
    return reported.groupBy("key", "doc_id").agg(F.max(F.when(F.col("kind") == -1, F.col("rows"))).alias("rows"), F.array_sort(F.collect_list(F.when(F.col("reported"), span))).alias("spans"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def scan(docs: DataFrame, reach: int = REACH, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of the base kinds, the digest of the base spans, and all spans, one row per row of ``docs``."""
    found = find(docs, reach, id, text)
    base = F.filter("spans", lambda s: s["base"])
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == KINDS.index(k))).cast("bigint").alias(f"n_{k}")
    rows = found.select("doc_id", *[count(k) for k in BASE], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("copy"))
    return rows.drop("copy")


def redact(docs: DataFrame, mark: str = "[SECRET]", reach: int = REACH, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every reported span replaced by ``mark``; rows without spans, and all other columns, stay as they are."""
    found = find(docs, reach, id, text).where(F.size("spans") > 0).select("key", "spans")
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))

    def replace(state: Column, s: Column) -> Column:
        gap = F.when(s["start"] >= state["at"], F.concat(F.substring("text", (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int")), F.lit(mark))).otherwise(F.lit(""))
        return F.struct(F.concat(state["out"], gap).alias("out"), F.greatest(state["at"], s["end"]).alias("at"))

    clean = F.aggregate("spans", start, replace, lambda s: F.concat(s["out"], F.substring("text", (s["at"] + 1).cast("int"), F.lit(2**31 - 1))))
    joined = packed(docs, text, text=F.col(text), key=row_key(id, text)).join(found, "key", "left")
    return unpacked(joined, docs, **{text: F.when(F.col("spans").isNull(), F.col("text")).otherwise(clean)})


def _sql() -> str:
    """The same scan on the checking engine."""
    quote = lambda p: "'" + p.replace("'", "''") + "'"
    every = BASE | WEAK
    kinds = "\nUNION ALL\n".join(
        f"SELECT rid, {i} AS kind, generate_subscripts(hits, 1) AS nth, unnest(hits) AS hit, unnest(pieces[1:len(hits)]) AS gap FROM "
        f"(SELECT rid, regexp_extract_all(text, {quote(every[k])}) AS hits, string_split_regex(text, {quote(every[k])}) AS pieces FROM docs) WHERE len(hits) > 0" for i, k in enumerate(KINDS))
    number = {k: i for i, k in enumerate(KINDS)}
    role = lambda r: ", ".join(str(number[k]) for k, x in ROLE.items() if x == r)
    meets = lambda r: f"EXISTS (SELECT 1 FROM scoped q WHERE q.rid = p.rid AND q.scope = p.scope AND q.kind IN ({role(r)}) AND q.start <= p.fin + {REACH} AND q.fin >= p.start - {REACH})"
    names = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
hits AS ({kinds}),
placed AS (SELECT rid, kind, hit, sum(length(gap) + length(hit)) OVER (PARTITION BY rid, kind ORDER BY nth) AS fin FROM hits),
parts AS (SELECT rid, kind, hit, fin, fin - length(hit) AS start FROM placed
  WHERE (kind <> 0 OR length(regexp_extract(hit, {quote(ASSIGN)}, 2)) >= {LEAST_VALUE})
    AND (kind <> {number['secret']} OR (regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[a-z]') AND regexp_matches(hit, '[A-Z]')))),
scoped AS (SELECT *, sum(CASE WHEN kind = {number['break']} THEN 1 ELSE 0 END) OVER w AS scope,
  coalesce(max(CASE WHEN kind < {len(BASE)} THEN fin END) OVER w >= fin, false) AS covered
  FROM parts WINDOW w AS (PARTITION BY rid ORDER BY start)),
judged AS (SELECT rid, kind, start, fin, kind < {len(BASE)} AS base,
  kind < {len(BASE)} OR (NOT covered AND CASE kind WHEN {number['ident']} THEN {meets('secret')} WHEN {number['secret']} THEN {meets('ident')}
    WHEN {number['endpoint']} THEN {meets('ident')} AND {meets('secret')} ELSE false END) AS reported FROM scoped p),
spans AS (SELECT rid, count(*) FILTER (WHERE kind = 0) AS a, count(*) FILTER (WHERE kind = 1) AS b, count(*) FILTER (WHERE kind = 2) AS c,
  string_agg({names}[kind + 1] || ':' || CAST(start AS BIGINT) || ':' || CAST(fin AS BIGINT), ',' ORDER BY start, kind) FILTER (WHERE base) AS base_list,
  string_agg({names}[kind + 1] || ':' || CAST(start AS BIGINT) || ':' || CAST(fin AS BIGINT), ',' ORDER BY start, kind) AS span_list FROM judged WHERE reported GROUP BY rid)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(base_list, '')) AS base_sha256, coalesce(span_list, '') AS spans
FROM docs LEFT JOIN spans USING (rid)"""


SQL = _sql()
