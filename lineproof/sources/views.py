"""Views over the given tables: T1 printed values, G1 positioned units, G2 label and value cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineproof.operators.joins import dealt


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


T1 = """select o_orderkey as notice_id, o_custkey, o_orderdate, o_totalprice,
    concat('신청 마감: ', {date}, ' ', lpad(cast(o_orderkey % 24 as {str}), 2, '0'), ':30') as deadline,
    concat('지원금 ', cast(cast(floor(o_totalprice) as bigint) as {str}), '원') as amount,
    concat('문의: 02-', lpad(cast(o_custkey % 10000 as {str}), 4, '0'), '-', lpad(cast(o_orderkey % 10000 as {str}), 4, '0'),
        ', c', cast(o_custkey as {str}), '@example.org') as contact,
    concat('KRW ', case when o_orderkey % 5 = 0 then '1' else cast(cast(floor(o_totalprice) as bigint) as {str}) end) as english
    from {orders}"""
G1 = """select notice_id, 1 as page_number, ord, l_partkey, l_suppkey,
    cast(l_partkey % 900 as int) as x, cast(60 * ord + l_suppkey % 7 as int) as y,
    cast(40 + l_partkey % 60 as int) as w, cast(18 + l_suppkey % 8 as int) as h, cast(50 + l_quantity as int) as conf
    from (select l_orderkey as notice_id, l_partkey, l_suppkey, l_quantity, cast(row_number() over (partition by l_orderkey
        order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) as int) as ord
        from {lineitem}) t"""
G2 = """select {div} as notice_id, 'label' as role, cast(p_partkey % 12 as int) as col,
    cast(100 + 70 * (p_partkey % 12) as int) as x, 100 as y, 40 as w, 20 as h, p_brand as txt from {part}
    union all
    select {div}, 'value', cast(p_partkey % 12 as int), cast(100 + 70 * (p_partkey % 12) + p_size % 11 as int),
    cast(130 + p_size % 40 as int), 40, 20, concat(cast(p_size as {str}), ' 이상') from {part}"""
SQL = {
    "t1": T1.format(date="strftime(o_orderdate, '%Y.%m.%d')", str="varchar", orders="orders"),
    "g1": G1.format(lineitem="lineitem"),
    "g2": G2.format(div="p_partkey // 12", str="varchar", part="part"),
}


def spread(spark: SparkSession, sf_dir: str, name: str, key: str, *columns: str) -> DataFrame:
    """Columns of a table, its rows dealt by key to all cores: a file of few row groups would leave a dear rule to as few tasks."""
    rows = table(spark, sf_dir, name)
    return dealt(rows.select(key, *columns), rows.count(), key)


def t1(spark: SparkSession, sf_dir: str, dear: bool = False) -> DataFrame:
    """dear: for rules that cost more than to move a row."""
    orders = spread(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice") if dear else table(spark, sf_dir, "orders")
    return spark.sql(T1.format(date="date_format(o_orderdate, 'yyyy.MM.dd')", str="string", orders="{orders}"), orders=orders)


def g1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units, dealt by notice to tasks of a bounded number of rows; what follows by notice needs no other exchange."""
    rows = table(spark, sf_dir, "lineitem")
    return spark.sql(G1, lineitem=dealt(rows, rows.count(), "l_orderkey"))


def g2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(G2.format(div="p_partkey div 12", str="string", part="{part}"), part=table(spark, sf_dir, "part"))


def cases(spark: SparkSession, sf_dir: str, rows: list[tuple], *names: str) -> DataFrame:
    """(notice_id, kase, names...): every order with one of the rows in turn; {n} in a text becomes a number of three digits."""
    o, n = table(spark, sf_dir, "orders"), F.col("o_orderkey") % 900 + 100
    kase = (F.col("o_orderkey") % len(rows)).cast("int")
    column = lambda i: F.replace(F.element_at(F.array(*[F.lit(r[i]).cast("string") for r in rows]), kase + 1), F.lit("{n}"), n.cast("string"))
    return o.select(F.col("o_orderkey").alias("notice_id"), kase.alias("kase"), *[column(i).alias(name) for i, name in enumerate(names)])


def cases_sql(expected: list[str | None]) -> str:
    """The SQL that lists what is expected of each order's row."""
    texts = ", ".join("null" if e is None else "'" + e.replace("'", "''") + "'" for e in expected)
    return f"select o_orderkey as notice_id, (o_orderkey % {len(expected)})::int as kase, replace(list_extract([{texts}], o_orderkey % {len(expected)} + 1)::varchar, '{{n}}', (o_orderkey % 900 + 100)::varchar) as found from orders"


def case_rows(spark: SparkSession, sf_dir: str, groups: list[list[tuple]], *names: str, dear: bool = False) -> DataFrame:
    """(notice_id, kase, i, names...): every order with the rows of one of the groups in turn; {n} as in cases, dear as in t1."""
    o, n = spread(spark, sf_dir, "orders", "o_orderkey") if dear else table(spark, sf_dir, "orders"), F.col("o_orderkey") % 900 + 100
    kase = (F.col("o_orderkey") % len(groups)).cast("int")
    kind = f"array<array<struct<{','.join(f'{c}:string' for c in names)}>>>"
    held = F.array(*[F.array(*[F.struct(*[F.lit(v).cast("string").alias(c) for c, v in zip(names, row, strict=True)]) for row in g]) for g in groups]).cast(kind)
    rows = o.select(F.col("o_orderkey").alias("notice_id"), n.cast("string").alias("n"), kase.alias("kase"), F.posexplode(F.element_at(held, kase + 1)).alias("i", "row"))
    return rows.select("notice_id", "kase", "i", *[F.replace(F.col("row")[c], F.lit("{n}"), F.col("n")).alias(c) for c in names])


def case_rows_sql(groups: list[list[str | None]]) -> str:
    """(notice_id, kase, i, found) of what is expected of each group's rows."""
    text = lambda e: "null" if e is None else "'" + e.replace("'", "''") + "'"
    lists = ", ".join("[" + ", ".join(map(text, g)) + "]::varchar[]" for g in groups)
    k = f"o_orderkey % {len(groups)}"
    return f"""with g as (select o_orderkey, list_extract([{lists}], {k} + 1) as found from orders)
        select o_orderkey as notice_id, ({k})::int as kase, unnest(range(len(found)))::int as i, replace(unnest(found), '{{n}}', (o_orderkey % 900 + 100)::varchar) as found from g"""
