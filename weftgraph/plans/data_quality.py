"""Queries of the general data-preparation operators (problems 2, 3 and 5)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.core.session import cut, read
from weftgraph.operators import missing, parsing, skew
from weftgraph.plans.registry import Registry

R = Registry()

_TYPE_KEY = "lower(trim(node_type, chr(32) || chr(9)))"


def _filled(spark: SparkSession, d: str) -> DataFrame:
    return missing.fill_missing(read(spark, d, "alircd_nodes"), read(spark, d, "node_types"))


@R.query(
    "p2_found",
    f"""
    SELECT DISTINCT node_id, 'node_type' AS field FROM alircd_nodes
    WHERE node_type IS NULL OR {_TYPE_KEY} NOT IN (SELECT lower(node_type) FROM node_types)
    UNION ALL
    SELECT DISTINCT node_id, 'node_embeds' FROM alircd_nodes
    WHERE node_embeds IS NULL OR len(node_embeds) < 64
       OR len(list_filter(node_embeds, lambda v: v IS NULL OR NOT isfinite(v))) > 0
       OR len(list_filter(node_embeds, lambda v: v IS NULL OR v <> 0)) = 0
    """,
)
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return missing.filled_fields(_filled(spark, d), "node_id", ["node_type", "node_embeds"])


@R.query("p2_fill")
def p2_fill(spark: SparkSession, d: str) -> DataFrame:
    return _filled(spark, d).withColumn("node_embeds", F.transform("node_embeds", lambda v: F.round(v, 6)))


@R.query("p2_score")
def p2_score(spark: SparkSession, d: str) -> DataFrame:
    """(field, method, n, score): a tenth of the known values hidden and filled again, by the mixture and by the session.

    score: share of right types, or the mean squared error of vectors' components.  The session's
    answers are its most frequent type (the smallest of equals) and its mean vector.
    """
    vec = F.col("node_embeds").cast("array<double>")
    one = read(spark, d, "alircd_nodes").filter("node_id is not null").groupBy("node_id").agg(F.min(F.struct("node_type", vec.alias("node_embeds"), "session_id", "seen_at")).alias("r"))
    types = read(spark, d, "node_types")
    known = cut(one.select("node_id", "r.*").join(
        F.broadcast(types.select(missing.type_key(F.col("node_type")).alias("k"), F.col("node_type").alias("truth"))),  # a fixed table
        missing.type_key(F.col("node_type")) == F.col("k"), "left",
    ).withColumn("x", F.when(~missing.vector_missing(F.col("node_embeds"), 64), F.col("node_embeds"))))
    drawn = lambda seed: F.pmod(F.xxhash64("node_id", F.lit(seed)), F.lit(10)) == 0
    hidden = known.select("node_id", "session_id", "seen_at", F.when(~drawn(1), F.col("truth")).alias("node_type"), F.when(~drawn(2), F.col("x")).alias("node_embeds"))
    asked_type, asked_vec = (known.filter(drawn(i) & F.col(c).isNotNull()).select("node_id", "session_id", F.col(c).alias("truth")) for i, c in ((1, "truth"), (2, "x")))
    filled = missing.fill_missing(hidden, types).select("node_id", "node_type", "node_embeds")
    mode = hidden.filter("node_type is not null").groupBy("session_id", "node_type").agg(F.count(F.lit(1)).alias("n"))
    mode = mode.groupBy("session_id").agg(F.min_by("node_type", F.struct(-F.col("n"), "node_type")).alias("node_type"))
    long = lambda df, key, x: df.select(key, F.posexplode(x).alias("p", "v"))
    mean = long(hidden.filter("node_embeds is not null"), "session_id", "node_embeds").groupBy("session_id", "p").agg(F.avg("v").alias("v"))
    n = F.count(F.lit(1)).alias("n")
    right = F.avg((F.col("truth") == F.col("node_type")).cast("double")).alias("score")
    error = F.avg((F.col("t") - F.col("v")) ** 2).alias("score")
    parts = asked_vec.select("node_id", "session_id", F.posexplode("truth").alias("p", "t"))
    out = [
        asked_type.join(filled, "node_id").agg(n, right).select(F.lit("node_type").alias("field"), F.lit("mixture").alias("method"), "n", "score"),
        asked_type.join(mode, "session_id").agg(n, right).select(F.lit("node_type").alias("field"), F.lit("session").alias("method"), "n", "score"),
        parts.join(long(filled, "node_id", "node_embeds"), ["node_id", "p"]).agg(n, error).select(F.lit("node_embeds").alias("field"), F.lit("mixture").alias("method"), "n", "score"),
        parts.join(mean, ["session_id", "p"]).agg(n, error).select(F.lit("node_embeds").alias("field"), F.lit("session").alias("method"), "n", "score"),
    ]
    return reduce(DataFrame.unionByName, out).withColumn("score", F.round("score", 4))


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    rules = parsing.rules_from(read(spark, d, "node_types"), read(spark, d, "edge_types"))
    return parsing.parse_records(read(spark, d, "alircd_raw"), rules)


_F = r'[ \t]*(?:"(?:[^"]|"")*"[ \t]*|[^" \t,][^",]*|)'
_N = r"[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?"
# A quoted field keeps what is between its quotes, blanks included; an unquoted one is trimmed.
_STRIP = (
    "CASE WHEN starts_with(trim({0}, chr(32) || chr(9)), '\"') THEN "
    "replace(substr(trim({0}, chr(32) || chr(9)), 2, length(trim({0}, chr(32) || chr(9))) - 2), '\"\"', '\"') "
    "ELSE trim({0}, chr(32) || chr(9)) END"
)
_PARSED_SQL = rf"""
    WITH l AS (
      SELECT file_name, line_no, regexp_replace(coalesce(line, ''), '\r$', '') AS s,
             CASE WHEN ends_with(file_name, '_nodes.csv') THEN 'node' WHEN ends_with(file_name, '_edges.csv') THEN 'edge' END AS kind
      FROM alircd_raw),
    q AS (
      SELECT *, regexp_full_match(s, '{_F}(?:,{_F})*', 's') AS quotes_ok FROM l),
    f AS (
      SELECT *, CASE WHEN quotes_ok THEN list_transform(regexp_extract_all(',' || s, ',({_F})', 1), lambda x: {_STRIP.format("x")}) END AS v FROM q),
    t AS (SELECT lower(node_type) AS k, node_type FROM node_types),
    e AS (SELECT lower(source_type) || ',' || lower(edge_type) || ',' || lower(dest_type) AS k, * FROM edge_types),
    r AS (
      SELECT *, CASE
        WHEN NOT quotes_ok THEN 'quoting'
        WHEN kind IS NULL OR (kind = 'node' AND len(v) <> 3) OR (kind = 'edge' AND len(v) <> 5) THEN 'columns'
        WHEN NOT regexp_full_match(v[1], '[0-9]+') OR try_cast(v[1] AS BIGINT) IS NULL THEN 'value'
        WHEN kind = 'node' AND (lower(v[2]) NOT IN (SELECT k FROM t) OR NOT (v[3] = '' OR
             (regexp_full_match(v[3], '{_N}(:{_N})*') AND len(string_split(v[3], ':')) = 64
              AND len(list_filter(string_split(v[3], ':'), lambda x: coalesce(isfinite(try_cast(ltrim(x, '+') AS DOUBLE)), false))) = 64))) THEN 'value'
        WHEN kind = 'edge' AND (NOT regexp_full_match(v[2], '[0-9]+') OR try_cast(v[2] AS BIGINT) IS NULL OR
             lower(v[3]) || ',' || lower(v[5]) || ',' || lower(v[4]) NOT IN (SELECT k FROM e)) THEN 'value'
        END AS reason FROM f)
"""


@R.query("p3_found", _PARSED_SQL + "SELECT file_name, line_no, reason FROM r WHERE reason IS NOT NULL")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return parsing.rejects(_parsed(spark, d))


@R.query(
    "p3_edges",
    _PARSED_SQL
    + """SELECT file_name, line_no, CAST(v[1] AS BIGINT) AS source_id, CAST(v[2] AS BIGINT) AS dest_id,
         e.source_type, e.dest_type, e.edge_type
         FROM r JOIN e ON lower(v[3]) || ',' || lower(v[5]) || ',' || lower(v[4]) = e.k WHERE reason IS NULL AND kind = 'edge'""",
)
def p3_edges(spark: SparkSession, d: str) -> DataFrame:
    return parsing.edge_records(_parsed(spark, d))


@R.query(
    "p3_nodes",
    _PARSED_SQL
    + """SELECT file_name, line_no, CAST(v[1] AS BIGINT) AS node_id, t.node_type, CAST(coalesce(x.pos, -1) AS BIGINT) AS pos, round(x.val, 6) AS val
         FROM r JOIN t ON lower(v[2]) = t.k LEFT JOIN LATERAL (
           SELECT unnest(range(64)) AS pos, unnest(list_transform(string_split(v[3], ':'), lambda z: CAST(ltrim(z, '+') AS DOUBLE))) AS val WHERE v[3] <> ''
         ) x ON true WHERE reason IS NULL AND kind = 'node'""",
)
def p3_nodes(spark: SparkSession, d: str) -> DataFrame:
    nodes = parsing.node_records(_parsed(spark, d))
    return nodes.select("file_name", "line_no", "node_id", "node_type", F.posexplode_outer("node_embeds").alias("pos", "val")).select(
        "file_name", "line_no", "node_id", "node_type", F.coalesce(F.col("pos").cast("bigint"), F.lit(-1)).alias("pos"), F.round("val", 6).alias("val")
    )


#: The value of an edge without weight: its other end, so that each node's neighbours are counted.
OTHER_END = "other"
_TABLES = (("graph_edges", "src", "dst", "w"), ("alircd_edges", "source_id", "dest_id", OTHER_END))


def _profiles(spark: SparkSession, d: str, points: dict[str, float] | None = None) -> list[tuple[str, DataFrame, int]]:
    out = []
    for table, src, dst, value in _TABLES:
        edges = read(spark, d, table)
        sides = skew.both_sides(edges, src, dst, None if value == OTHER_END else F.col(value))
        out.append((table, skew.profile_by_key(sides, ["side", "node_id"], "value", points), edges.count()))
    return out


@R.query(
    "p5_found",
    " UNION ALL ".join(
        f"SELECT '{t}' AS edge_table, '{side}' AS side, {c} AS node_id FROM {t} WHERE {c} IS NOT NULL "
        f"GROUP BY {c} HAVING count(*) >= 0.02 * (SELECT count(*) FROM {t})"
        for t, s, o, _ in _TABLES for side, c in (("src", s), ("dst", o))
    ),
)
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    (ta, pa, na), (tb, pb, nb) = _profiles(spark, d)
    a, b = skew.hot_keys(pa, na), skew.hot_keys(pb, nb)
    pick = lambda t, x: x.select(F.lit(t).alias("edge_table"), "side", "node_id")
    return pick(ta, a).unionByName(pick(tb, b))


def _p5_sql() -> str:
    parts, ctes = [], []
    for t, s, o, w in _TABLES:
        for side, c in (("src", s), ("dst", o)):
            v = f"CAST({o if side == 'src' else s} AS DOUBLE)" if w == OTHER_END else f"CASE WHEN NOT isnan({w}) THEN {w} END"
            x = f"{t}_{side}"
            ctes.append(f"b_{x} AS (SELECT {c} AS k, {v} AS v FROM {t} WHERE {c} IS NOT NULL)")
            ctes.append(f"n_{x} AS (SELECT k, v, count(*) AS n FROM b_{x} WHERE v IS NOT NULL GROUP BY k, v)")
            ctes.append(
                f"m_{x} AS (SELECT k, arg_min(v, v) FILTER (n = top) AS mode, min(v) FILTER (rn >= ceil(0.5 * tot)) AS p50, "
                f"min(v) FILTER (rn >= ceil(0.9 * tot)) AS p90 FROM (SELECT *, max(n) OVER (PARTITION BY k) AS top, "
                f"sum(n) OVER (PARTITION BY k ORDER BY v) AS rn, sum(n) OVER (PARTITION BY k) AS tot FROM n_{x}) GROUP BY k)"
            )
            parts.append(
                f"SELECT '{t}' AS edge_table, '{side}' AS side, b.k AS node_id, count(*) AS n_rows, count(v) AS n_values, "
                f"count(DISTINCT v) AS n_distinct, round(sum(v), 6) AS total, any_value(m.mode) AS mode, any_value(m.p50) AS p50, any_value(m.p90) AS p90 "
                f"FROM b_{x} b LEFT JOIN m_{x} m ON b.k = m.k GROUP BY b.k"
            )
    return "WITH " + ", ".join(ctes) + " " + " UNION ALL ".join(parts)


@R.query("p5_profile", _p5_sql())
def p5_profile(spark: SparkSession, d: str) -> DataFrame:
    parts = [
        p.select(F.lit(t).alias("edge_table"), "side", "node_id", "n_rows", "n_values", "n_distinct",
                 F.round("total", 6).alias("total"), "mode", "p50", "p90")
        for t, p, _ in _profiles(spark, d, {"p50": 0.5, "p90": 0.9})
    ]
    return parts[0].unionByName(parts[1])
