"""Adapter views: queue, workflow and publish/subscribe tables derived from the star-schema tables.

The text of a view is neutral between Spark SQL and the oracle's SQL except for `{ms:col}`, which stands for the
milliseconds since the epoch of a timestamp column.
"""

import re

#: The clocks of the views: jobs, workers and subscriptions live at NOW_JOBS, events at NOW_EVENTS.
NOW_JOBS = 915148800000
NOW_EVENTS = 1706659200000

#: The tables whose rows views number within a key, by windows.
NUMBERED = {"lineitem": "l_orderkey"}

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

# The views' definitions.
VIEWS = {
    "jobs_all": """
select lpad(cast(o_orderkey as string),12,'0') as id,
  concat('q',cast(o_custkey%4 as string)) as queue,
  concat('task_',cast(o_custkey%8 as string)) as task_name,
  cast(case o_orderstatus when 'O' then 0 when 'P' then 1 else case when o_orderkey%10<7 then 2 else cast(o_orderkey%10 as int)-4 end end as int) as status,
  6-cast(substr(o_orderpriority,1,1) as int) as priority,
  {ms:o_orderdate} as created_at,
  {ms:o_orderdate}+(o_orderkey%7)*3600000 as scheduled_at,
  case when o_orderstatus='O' then cast(null as bigint) else {ms:o_orderdate}+(o_orderkey%7)*3600000+1000 end as started_at,
  case when o_orderstatus='F' then {ms:o_orderdate}+(o_orderkey%7)*3600000+1000+(o_orderkey%97)*500 else cast(null as bigint) end as completed_at,
  cast(o_orderkey%4 as int) as retry_count, 3 as max_retries,
  case when o_orderstatus='F' and o_orderkey%10>=7 then concat('ValueError: bad order ',cast(o_orderkey%13 as string)) else cast(null as string) end as error,
  cast(300000 as bigint) as timeout_ms,
  case when o_orderkey%3=0 then concat('uk',cast(o_orderkey%500 as string)) else cast(null as string) end as unique_key,
  case when o_orderkey%2=0 then concat('{"cust":',cast(o_custkey as string),'}') else cast(null as string) end as metadata,
  case when o_orderkey%11=0 then {ms:o_orderdate}+86400000 else cast(null as bigint) end as expires_at,
  case when o_orderkey%6=0 then (o_orderkey%30)*86400000 else cast(null as bigint) end as result_ttl_ms,
  case when o_custkey%5=0 then cast(null as string) else concat('ns',cast(o_custkey%3 as string)) end as namespace,
  (o_orderkey between 1 and 4000 and o_orderkey%3<>0) as has_deps
from orders
""",
    "job_dependencies": """
select lpad(cast(o_orderkey as string),12,'0') as job_id, lpad(cast(cast(floor(o_orderkey/2.0) as bigint) as string),12,'0') as depends_on_job_id
from orders where o_orderkey between 1 and 4000 and o_orderkey%3<>0
""",
    "job_errors": """
select concat(lpad(cast(l_orderkey as string),12,'0'),'-',lpad(cast(row_number() over (partition by l_orderkey order by l_linenumber,l_partkey,l_suppkey,l_quantity,l_extendedprice,l_discount,l_tax,l_shipdate) as string),3,'0')) as id, lpad(cast(l_orderkey as string),12,'0') as job_id,
  cast(row_number() over (partition by l_orderkey order by l_linenumber,l_partkey,l_suppkey,l_quantity,l_extendedprice,l_discount,l_tax,l_shipdate) as int) as attempt,
  concat('TimeoutError: part ',cast(l_partkey%17 as string)) as error, {ms:l_shipdate} as failed_at
from lineitem where l_returnflag='R'
""",
    "dead_letter": """
select concat('d',lpad(cast(o_orderkey as string),12,'0')) as id, lpad(cast(o_orderkey as string),12,'0') as original_job_id,
  concat('q',cast(o_custkey%4 as string)) as queue, concat('task_',cast(o_custkey%8 as string)) as task_name,
  case when o_orderkey%3=0 then concat('codel: sojourn ',cast(o_custkey as string)) when o_orderkey%3=1 then concat('ValueError: bad order ',cast(o_orderkey%13 as string)) else 'KeyError: missing' end as error,
  {ms:o_orderdate}+7200000 as failed_at, cast(cast(floor(o_orderkey/10.0) as bigint)%5 as int) as dlq_retry_count, (o_orderkey%3=0) as shed,
  case when o_orderkey%6=2 then (o_orderkey%30)*86400000 else cast(null as bigint) end as result_ttl_ms,
  case when o_custkey%5=0 then cast(null as string) else concat('ns',cast(o_custkey%3 as string)) end as namespace
from orders where o_orderstatus='F' and o_orderkey%10=8
""",
    "execution_claims": """
select lpad(cast(o_orderkey as string),12,'0') as job_id, concat('w',cast(o_custkey%120 as string)) as worker_id, {ms:o_orderdate} as claimed_at
from orders where o_orderstatus='P'
""",
    "workers": """
select concat('w',cast(s_suppkey as string)) as worker_id, cast(915148800000 as bigint)-(s_suppkey%60)*1000 as last_heartbeat,
  cast(1+s_suppkey%8 as int) as threads, case when s_suppkey%9=0 then cast(null as string) else concat('fp',cast(s_suppkey%7 as string)) end as registry_fingerprint
from supplier
""",
    "task_metrics": """
select lpad(cast(event_id as string),12,'0') as id, event_type as task_name, lpad(cast(user_id as string),12,'0') as job_id,
  cast(round(value*1000) as bigint)*1000 as wall_time_ns, cast(0 as bigint) as memory_bytes, event_type<>'error' as succeeded, {ms:ts} as recorded_at,
  case when user_id%4=0 then cast(null as string) else concat('ns',cast(user_id%3 as string)) end as namespace
from events
""",
    "task_logs": """
select lpad(cast(event_id as string),12,'0') as id, lpad(cast(user_id as string),12,'0') as job_id, concat('task_',cast(user_id%8 as string)) as task_name,
  case when event_type='error' then 'error' when event_type='signup' then 'warning' else 'info' end as level, event_type as message, props as extra, {ms:ts} as logged_at
from events
""",
    "topic_subscriptions": """
select concat('t',cast(n_regionkey as string)) as topic, n_name as subscription_name, concat('task_',cast(n_nationkey%8 as string)) as task_name,
  concat('q',cast(n_nationkey%4 as string)) as queue, (n_nationkey%5<>4) as active, (n_nationkey%3<>0) as durable,
  case when n_nationkey%3=0 then concat('w',cast(n_nationkey%120 as string)) else cast(null as string) end as owner_worker_id,
  cast(915148800000 as bigint)-n_nationkey*10000 as created_at,
  case when n_nationkey%2=0 then 'log' else 'fanout' end as mode,
  case when n_nationkey%2=0 and n_nationkey%6<>0 then lpad(cast(n_nationkey*300 as string),12,'0') else cast(null as string) end as cursor,
  case when n_nationkey%4=1 then cast(n_nationkey%6 as int) else cast(null as int) end as priority
from nation
""",
    "topic_messages": """
select lpad(cast(event_id as string),12,'0') as id, concat('t',cast(user_id%5 as string)) as topic, props as metadata, {ms:ts} as created_at,
  case when event_id%9=0 then {ms:ts}+3600000 else cast(null as bigint) end as expires_at
from events
""",
    "topic_deliveries": """
select concat('t',cast(e.user_id%5 as string)) as topic, n.n_name as subscription_name, lpad(cast(e.event_id as string),12,'0') as message_id,
  ((e.event_id+n.n_nationkey)%3<>0) as acked, cast(1+e.event_id%3 as int) as attempts,
  cast(1706659200000 as bigint)+((e.event_id%21)-10)*1000 as lease_expires_at
from events e join nation n on n.n_regionkey=e.user_id%5 and n.n_nationkey%2=0 where (e.event_id+n.n_nationkey)%4<>0
""",
    "workflow_definitions": """
select cast(r_regionkey as string) as id, concat('wf_',lower(r_name)) as name, 1 as version from region
""",
    "workflow_runs": """
select lpad(cast(c_custkey as string),12,'0') as id, cast(c_nationkey%5 as string) as definition_id,
  case when c_custkey%10<6 then 'completed' when c_custkey%10=6 then 'failed' when c_custkey%10=7 then 'running' when c_custkey%10=8 then 'completed_with_failures' else 'pending' end as state,
  cast(900000000000 as bigint)+(c_custkey*7919%100000)*60000 as created_at,
  case when c_custkey%20=0 and c_custkey>0 then lpad(cast(c_custkey-1 as string),12,'0') else cast(null as string) end as parent_run_id
from customer
""",
    "workflow_nodes": """
select lpad(cast(l_orderkey as string),12,'0') as run_id, cast(row_number() over (partition by l_orderkey order by l_linenumber,l_partkey,l_suppkey,l_quantity,l_extendedprice,l_discount,l_tax,l_shipdate) as int) as line,
  concat('n',cast(row_number() over (partition by l_orderkey order by l_linenumber,l_partkey,l_suppkey,l_quantity,l_extendedprice,l_discount,l_tax,l_shipdate) as string)) as node_name,
  case l_returnflag when 'A' then 'completed' when 'R' then 'failed' else 'pending' end as status, l_quantity as cost,
  case when l_linestatus='F' then concat('h',cast(l_partkey as string)) else cast(null as string) end as result_hash
from lineitem
""",
    "submissions": """
select event_id as seq, concat('k',cast(user_id%20 as string)) as key, {ms:ts} as at_ms, event_type='error' as failed, cast(round(value*1000) as bigint) as sojourn_ms
from events
""",
    "jobs": "select * from jobs_all where status in (0,1)",
    "archived_jobs": "select * from jobs_all where status in (2,3,4,5)",
}


def used(sql: str) -> list[str]:
    """The views that a query needs, each after those that it needs itself."""
    found: list[str] = []
    for name in VIEWS:
        if re.search(rf"\b{name}\b(?!\s*\()", sql):
            for n in [*used(VIEWS[name]), name]:
                if n not in found:
                    found.append(n)
    return found


def duckdb(sql: str) -> str:
    """The query with the views that it needs, as one statement over the star-schema tables."""
    names = used(sql)
    views = ",\n".join(f"{n} as ({re.sub(r'{ms:(.*?)}', r'(epoch_us(' + chr(92) + '1)//1000)', VIEWS[n])})" for n in names)
    if not names:
        return sql
    body = sql.strip()
    if m := re.match(r"with\s+(recursive\s+)?", body, re.I):
        return f"with {m[1] or ''}{views},\n{body[m.end():]}"
    return f"with {views}\n{body}"


def numbered(name: str) -> str | None:
    """The table whose rows the view numbers, if it does."""
    return next((t for t, key in NUMBERED.items() if f"over (partition by {key} " in VIEWS.get(name, "")), None)


def spark_view(name: str, sf_dir: str, parts: int | None = None) -> str:
    """The view as Spark SQL that reads the Parquet tables of a folder. With `parts`, the windows of a view that numbers rows
    have so many partitions."""
    sql = re.sub(r"{ms:(.*?)}", r"(unix_micros(cast(\1 as timestamp)) div 1000)", VIEWS[name])
    for inner in used(VIEWS[name]):
        sql = re.sub(rf"\b(from|join)\s+{inner}\b", lambda m, i=inner: f"{m[1]} ({spark_view(i, sf_dir)})", sql)

    def read(m: re.Match) -> str:
        path = f"parquet.`{sf_dir}/{m[2]}.parquet`"
        return f"{m[1]} (select /*+ repartition({parts}, {NUMBERED[m[2]]}) */ * from {path})" if parts and m[2] == numbered(name) else f"{m[1]} {path}"

    return re.sub(rf"\b(from|join)\s+({'|'.join(BASE)})\b", read, sql)
