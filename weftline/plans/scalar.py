"""Scalar functions, grouped into wide queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.plans.base import Catalog, Tables

QUERIES = Catalog()

QUERIES.same_sql(
    "s_strings",
    """SELECT p_partkey, upper(p_name) AS a, lower(p_brand) AS b, CAST(length(p_name) AS BIGINT) AS c, trim(concat('  ', p_name, ' ')) AS d,
    substr(p_name, 2, 3) AS e, left(p_name, 3) AS f, right(p_name, 2) AS g, lpad(p_brand, 12, '*') AS h, rpad(p_brand, 12, '-') AS i,
    repeat('ab', 3) AS j, reverse(p_name) AS k, replace(p_name, 'a', 'A') AS l, translate(p_name, 'aei', '123') AS m,
    concat_ws('/', p_brand, p_type) AS n, split_part(concat(p_brand, '#', p_type), '#', 2) AS o,
    CAST(instr(p_name, 'a') AS BIGINT) AS p, contains(p_name, 'e') AS q, CAST(ascii(p_name) AS BIGINT) AS r, chr(65 + p_size % 26) AS s,
    CAST(levenshtein(p_brand, p_type) AS BIGINT) AS t, starts_with AS u
    FROM (SELECT *, startswith(p_name, 'P') AS starts_with FROM part) x""",
    """SELECT p_partkey, upper(p_name) AS a, lower(p_brand) AS b, CAST(length(p_name) AS BIGINT) AS c, trim(concat('  ', p_name, ' ')) AS d,
    substr(p_name, 2, 3) AS e, left(p_name, 3) AS f, right(p_name, 2) AS g, lpad(p_brand, 12, '*') AS h, rpad(p_brand, 12, '-') AS i,
    repeat('ab', 3) AS j, reverse(p_name) AS k, replace(p_name, 'a', 'A') AS l, translate(p_name, 'aei', '123') AS m,
    concat_ws('/', p_brand, p_type) AS n, split_part(concat(p_brand, '#', p_type), '#', 2) AS o,
    CAST(instr(p_name, 'a') AS BIGINT) AS p, contains(p_name, 'e') AS q, CAST(ascii(p_name) AS BIGINT) AS r, chr(65 + p_size % 26) AS s,
    CAST(levenshtein(p_brand, p_type) AS BIGINT) AS t, starts_with(p_name, 'P') AS u FROM part""",
)
QUERIES.same_sql(
    "s_search",
    "SELECT p_partkey, initcap(concat(p_name, ' OF ', p_type)) AS a, CAST(locate('a', p_name, 2) AS BIGINT) AS b FROM part",
    """SELECT p_partkey, array_to_string(list_transform(string_split(concat(p_name, ' OF ', p_type), ' '),
    lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ') AS a,
    CASE WHEN instr(substr(p_name, 2), 'a') = 0 THEN 0 ELSE instr(substr(p_name, 2), 'a') + 1 END::BIGINT AS b FROM part""",
)
QUERIES.same_sql(
    "s_digests",
    "SELECT c_custkey, md5(c_name) AS a, sha2(c_name, 256) AS b, base64(CAST(c_name AS BINARY)) AS c, hex(c_name) AS d FROM customer",
    "SELECT c_custkey, md5(c_name) AS a, sha256(c_name) AS b, base64(encode(c_name)) AS c, hex(c_name) AS d FROM customer",
)


@QUERIES.add(
    r"""SELECT url, regexp_extract(url, '^(\w+)://([^/]+)', 2) AS host, regexp_replace(url, '[0-9]+', '#', 'g') AS masked,
    array_to_string(regexp_extract_all(url, '[0-9]+'), ',') AS numbers, strlen(html)::BIGINT AS n_bytes FROM pages"""
)
def s_regex(t: Tables) -> DataFrame:
    return t.pages.select(
        "url",
        F.regexp_extract("url", r"^(\w+)://([^/]+)", 2).alias("host"),
        F.regexp_replace("url", "[0-9]+", "#").alias("masked"),
        F.array_join(F.regexp_extract_all("url", F.lit("[0-9]+"), 0), ",").alias("numbers"),
        F.octet_length("html").cast("long").alias("n_bytes"),
    )


QUERIES.same_sql(
    "m_numbers",
    """SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey, abs(l_discount - 0.05) AS a, round(l_extendedprice / 7, 3) AS b, bround(l_quantity / 4, 0) AS c,
    CAST(floor(l_extendedprice) AS BIGINT) AS d, CAST(ceil(l_tax * 100) AS BIGINT) AS e, round(sqrt(l_quantity), 8) AS f,
    round(cbrt(l_quantity), 8) AS g, round(ln(l_quantity + 1), 8) AS h, round(log10(l_extendedprice + 1), 8) AS i, round(exp(l_tax), 8) AS j,
    pow(l_quantity, 2) AS k, CAST(sign(l_quantity - 25) AS DOUBLE) AS l, round(sin(l_quantity), 8) AS m, round(atan2(l_tax, l_discount + 1), 8) AS n,
    round(degrees(l_tax), 8) AS o, l_orderkey % 7 AS p, l_orderkey div 7 AS q, try_divide(l_quantity, l_tax) AS r,
    CAST(CAST(l_extendedprice AS INT) AS BIGINT) AS s FROM lineitem""",
    """SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey, abs(l_discount - 0.05) AS a, round(l_extendedprice / 7, 3) AS b, round_even(l_quantity / 4, 0) AS c,
    CAST(floor(l_extendedprice) AS BIGINT) AS d, CAST(ceil(l_tax * 100) AS BIGINT) AS e, round(sqrt(l_quantity), 8) AS f,
    round(cbrt(l_quantity), 8) AS g, round(ln(l_quantity + 1), 8) AS h, round(log10(l_extendedprice + 1), 8) AS i, round(exp(l_tax), 8) AS j,
    pow(l_quantity, 2) AS k, CAST(sign(l_quantity - 25) AS DOUBLE) AS l, round(sin(l_quantity), 8) AS m, round(atan2(l_tax, l_discount + 1), 8) AS n,
    round(degrees(l_tax), 8) AS o, l_orderkey % 7 AS p, l_orderkey // 7 AS q, CASE WHEN l_tax <> 0 THEN l_quantity / l_tax END AS r,
    CAST(trunc(l_extendedprice) AS BIGINT) AS s FROM lineitem""",
)
QUERIES.same_sql(
    "m_integers",
    """SELECT n_nationkey, factorial(n_nationkey % 15) AS a, CAST(width_bucket(n_nationkey, 0, 25, 5) AS BIGINT) AS b, n_nationkey & 6 AS c, n_nationkey | 1 AS d FROM nation""",
    """SELECT n_nationkey, factorial(n_nationkey % 15)::BIGINT AS a, CAST(floor(n_nationkey / 5.0) + 1 AS BIGINT) AS b, n_nationkey & 6 AS c, n_nationkey | 1 AS d FROM nation""",
)
QUERIES.same_sql(
    "d_parts",
    """SELECT event_id, CAST(year(ts) AS BIGINT) AS a, CAST(quarter(ts) AS BIGINT) AS b, CAST(month(ts) AS BIGINT) AS c, CAST(day(ts) AS BIGINT) AS d,
    CAST(hour(ts) AS BIGINT) AS e, CAST(minute(ts) AS BIGINT) AS f, CAST(second(ts) AS BIGINT) AS g, CAST(dayofyear(ts) AS BIGINT) AS h,
    CAST(weekofyear(ts) AS BIGINT) AS i, CAST(dayofweek(ts) AS BIGINT) AS j FROM events""",
    """SELECT event_id, year(ts) AS a, quarter(ts) AS b, month(ts) AS c, day(ts) AS d, hour(ts) AS e, minute(ts) AS f, second(ts)::BIGINT AS g,
    dayofyear(ts) AS h, weekofyear(ts) AS i, dayofweek(ts) + 1 AS j FROM events""",
)
QUERIES.same_sql(
    "d_arithmetic",
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, date_add(CAST(o_orderdate AS DATE), 10) AS b,
    CAST(datediff(DATE'2001-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS c, add_months(CAST(o_orderdate AS DATE), 2) AS d,
    last_day(CAST(o_orderdate AS DATE)) AS e, CAST(date_trunc('week', o_orderdate) AS TIMESTAMP_NTZ) AS f, trunc(CAST(o_orderdate AS DATE), 'month') AS g,
    date_format(o_orderdate, 'yyyy/MM/dd') AS h, CAST(timestampdiff(HOUR, o_orderdate, TIMESTAMP_NTZ'2001-01-01 00:00:00') AS BIGINT) AS i,
    o_orderdate + INTERVAL 36 HOURS AS j FROM orders""",
    """SELECT o_orderkey, o_orderdate::DATE AS a, (o_orderdate::DATE + 10) AS b, datediff('day', o_orderdate::DATE, DATE '2001-01-01') AS c,
    (o_orderdate::DATE + INTERVAL 2 MONTH)::DATE AS d, last_day(o_orderdate::DATE) AS e, date_trunc('week', o_orderdate)::TIMESTAMP AS f,
    date_trunc('month', o_orderdate)::DATE AS g, strftime(o_orderdate, '%Y/%m/%d') AS h,
    datesub('hour', o_orderdate, TIMESTAMP '2001-01-01') AS i, o_orderdate + INTERVAL 36 HOURS AS j FROM orders""",
)
QUERIES.same_sql(
    "d_differences",
    """SELECT o_orderkey, months_between(CAST(o_orderdate AS DATE), DATE'1996-03-31') AS a,
    CAST(extract(DAY FROM o_orderdate - TIMESTAMP_NTZ'1994-01-01 00:00:00') AS BIGINT) AS b,
    CAST(from_utc_timestamp(CAST(o_orderdate AS TIMESTAMP), 'America/New_York') AS TIMESTAMP_NTZ) AS c FROM orders""",
    """SELECT o_orderkey, round((year(d) - 1996) * 12 + month(d) - 3 + CASE WHEN day(d) = 31 OR d = last_day(d) THEN 0
    ELSE (day(d) - 31) / 31.0 END, 8) AS a,
    extract('day' FROM o_orderdate - TIMESTAMP '1994-01-01') AS b, timezone('America/New_York', timezone('UTC', o_orderdate)) AS c
    FROM (SELECT *, o_orderdate::DATE AS d FROM orders)""",
)
QUERIES.same_sql(
    "d_making",
    """SELECT n_nationkey, make_date(2020, 1 + n_nationkey % 12, 15) AS a, CAST(to_timestamp_ntz('2020-02-03 04:05:06') AS TIMESTAMP_NTZ) AS b,
    unix_timestamp(TIMESTAMP'2020-02-03 04:05:06') AS c FROM nation""",
    """SELECT n_nationkey, make_date(2020, 1 + n_nationkey % 12, 15) AS a, TIMESTAMP '2020-02-03 04:05:06' AS b,
    epoch(TIMESTAMP '2020-02-03 04:05:06')::BIGINT AS c FROM nation""",
)


@QUERIES.add(
    """SELECT vec_id, len(embedding)::BIGINT AS n, embedding[1]::DOUBLE AS first1, round(list_max(embedding)::DOUBLE, 5) AS most,
    list_contains([1, 2, label], 2) AS has2, len(list_distinct([label, 1, 2]))::BIGINT AS n_distinct,
    array_to_string(list_sort([label, 5, 3]), ',') AS sorted, array_to_string(range(1, label + 1), ',') AS seq,
    array_to_string(list_transform([1, 2, label], lambda x: x * 2), ',') AS doubled,
    array_to_string(list_filter([1, 2, label], lambda x: x > 1), ',') AS large, list_sum([1, 2, label])::BIGINT AS total,
    list_position([7, label, 9], 9)::BIGINT AS at9, array_to_string(flatten([[1], [label, 2]]), ',') AS flat FROM embeddings"""
)
def c_arrays(t: Tables) -> DataFrame:
    label = F.col("label")

    def array(*xs) -> F.Column:
        return F.array(*[F.lit(x) if isinstance(x, int) else x for x in xs])

    def text(column) -> F.Column:
        return F.array_join(column.cast("array<string>"), ",")

    total = F.aggregate(array(1, 2, label), F.lit(0), lambda a, x: a + x).cast("long")
    return t.embeddings.select(
        "vec_id",
        F.size("embedding").cast("long").alias("n"),
        F.element_at("embedding", 1).cast("double").alias("first1"),
        F.round(F.array_max("embedding").cast("double"), 5).alias("most"),
        F.array_contains(array(1, 2, label), 2).alias("has2"),
        F.size(F.array_distinct(array(label, 1, 2))).cast("long").alias("n_distinct"),
        text(F.sort_array(array(label, 5, 3))).alias("sorted"),
        F.when(label > 0, text(F.sequence(F.lit(1), F.greatest(label, F.lit(1))))).otherwise("").alias("seq"),
        text(F.transform(array(1, 2, label), lambda x: x * 2)).alias("doubled"),
        text(F.filter(array(1, 2, label), lambda x: x > 1)).alias("large"),
        total.alias("total"),
        F.array_position(array(7, label, 9), 9).alias("at9"),
        text(F.flatten(F.array(array(1), array(label, 2)))).alias("flat"),
    )


@QUERIES.add(
    """SELECT vec_id, array_to_string(list_sort(list_distinct([label, 3, 7, 3, label + 1])), ',') AS united,
    array_to_string([label, 4, 5, 6][2:3], ',') AS middle, '1:' || label || ',2:9' AS zipped,
    len(list_filter([label, 2], lambda x: x > 6)) > 0 AS some_large FROM embeddings"""
)
def c_sets(t: Tables) -> DataFrame:
    label = F.col("label")
    united = F.array_union(F.array(label, F.lit(3)), F.array(F.lit(7), F.lit(3), label + 1))
    zipped = F.arrays_zip(F.array(F.lit(1), F.lit(2)).alias("a"), F.array(label, F.lit(9)).alias("b"))
    return t.embeddings.select(
        "vec_id",
        F.array_join(F.sort_array(united).cast("array<string>"), ",").alias("united"),
        F.array_join(F.slice(F.array(label, F.lit(4), F.lit(5), F.lit(6)), 2, 2).cast("array<string>"), ",").alias("middle"),
        F.array_join(F.transform(zipped, lambda z: F.concat_ws(":", z["a"].cast("string"), z["b"].cast("string"))), ",").alias("zipped"),
        F.exists(F.array(label, F.lit(2)), lambda x: x > 6).alias("some_large"),
    )


@QUERIES.add(
    """SELECT e1.vec_id AS a, e2.vec_id AS b, round(list_sum(list_transform(list_zip(e1.embedding, e2.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)), 5) AS dot
    FROM embeddings e1 JOIN embeddings e2 ON e2.vec_id = e1.vec_id + 1"""
)
def c_zip_with(t: Tables) -> DataFrame:
    a = t.embeddings.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x"))
    b = t.embeddings.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    product = F.zip_with("x", "y", lambda p, q: p.cast("double") * q.cast("double"))
    return a.join(b, "a").select("a", "b", F.round(F.aggregate(product, F.lit(0.0), lambda s, v: s + v), 5).alias("dot"))


@QUERIES.add("SELECT n_nationkey, pos, word FROM (SELECT n_nationkey, unnest(string_split(n_name, '_')) AS word, (generate_subscripts(string_split(n_name, '_'), 1) - 1)::INTEGER AS pos FROM nation)")
def c_posexplode(t: Tables) -> DataFrame:
    return t.nation.select("n_nationkey", F.posexplode(F.split("n_name", "_")).alias("pos", "word"))


@QUERIES.add("SELECT p_partkey, p_size AS by_key, 2::BIGINT AS n, p_brand AS brand FROM part")
def c_maps_structs(t: Tables) -> DataFrame:
    made = F.create_map(F.lit("size"), F.col("p_size"), F.lit("key"), F.col("p_partkey").cast("int"))
    whole = F.struct("p_brand", F.struct("p_type").alias("inner"))
    return t.part.select(
        "p_partkey",
        F.element_at(made, "size").alias("by_key"),
        F.size(F.map_keys(made)).cast("long").alias("n"),
        whole["p_brand"].alias("brand"),
    )


@QUERIES.add(
    """SELECT event_id, (props::JSON ->> '$.k')::INTEGER AS k, json_array_length('[1,2,3]')::BIGINT AS n, (props::JSON ->> 'k')::INTEGER AS k2,
    (props::JSON ->> 'k')::INTEGER AS k3 FROM events"""
)
def n_json(t: Tables) -> DataFrame:
    return t.events.select(
        "event_id",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.json_array_length(F.lit("[1,2,3]")).cast("long").alias("n"),
        F.from_json("props", "k int")["k"].alias("k2"),
        F.variant_get(F.parse_json("props"), "$.k", "int").alias("k3"),
    )


@QUERIES.add("SELECT r_regionkey, '{\"k\":' || r_regionkey || ',\"n\":\"' || r_name || '\"}' AS j, 'k,n' AS keys FROM region")
def n_to_json(t: Tables) -> DataFrame:
    made = F.to_json(F.struct(F.col("r_regionkey").alias("k"), F.col("r_name").alias("n")))
    return t.region.select("r_regionkey", made.alias("j"), F.array_join(F.json_object_keys(made), ",").alias("keys"))


@QUERIES.add(
    """SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS roles, count(*) AS n_turns, sum(length(text))::BIGINT AS n_chars
    FROM conversations GROUP BY conv_id"""
)
def x_conversation_rollup(t: Tables) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return t.conversations.groupBy("conv_id").agg(
        F.array_join(F.transform(ordered, lambda x: x["role"]), ">").alias("roles"),
        F.count("*").alias("n_turns"),
        F.sum(F.length("text")).alias("n_chars"),
    )


@QUERIES.add(
    """SELECT quality, toxic, count(*) AS n, round(avg(n_chars), 4) AS mean_chars FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2"""
)
def x_label_join(t: Tables) -> DataFrame:
    both = t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id")
    return both.groupBy("quality", "toxic").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 4).alias("mean_chars"))
