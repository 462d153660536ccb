"""Common table expressions of the oracle queries."""

SER = "ser as (select o_orderpriority as series, cast(o_orderdate as date) as d, avg(o_totalprice) as v from orders group by 1, 2)"
LINE = "line as (select concat(l_returnflag, l_linestatus) as series, cast(l_shipdate as date) as d, avg(l_extendedprice) as v from lineitem group by 1, 2)"
FRIDAY = "cast(d + cast((12 - isodow(d)) % 7 as integer) as date)"
WEEK = f"week as (select series, {FRIDAY} as d, arg_max(v, d) as v from ser group by 1, 2)"
NEWEST = "newest as (select *, row_number() over (partition by series order by d desc) as rn, row_number() over (partition by series order by d) as up, count(*) over (partition by series) as n from ser)"
DAY = "cast(d as varchar) as d"


def r(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0"


def with_(*parts: str) -> str:
    return "with " + ", ".join(parts) + " "
