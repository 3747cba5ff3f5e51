"""Registered scalar functions and predicates."""

from pyspark.sql import functions as F

from opsloom.functions import exprs as X
from opsloom.functions import predicates as P
from opsloom.functions import udfs as U
from opsloom.plans.registry import query
from opsloom.sources.adapters import NOW_JOBS

RATE_FORMS = ["100/m", "50/s", "3600/h", "x/m", "{n}/min", " {n} / hour ", "{n}/sec", "{n}/hr", "{n}/second", "{n}/minute", "{n}/day", "1/2/s", "{n}.5/M", "+{n}e1/m"]
DURATION_FORMS = ["{n}ms", "{n}s", "{n}m", "{n}h", "{n}d", "{n}MS", " {n} S ", "{n}.5M", "{n}H", "{n}.25D", "{n}", "{n}.0005s", "-{n}s", "x"]


def forms(c, texts: list[str]):
    """event_id and t: the texts in turn, with the user's number in place of {n}."""
    picked = F.element_at(F.array(*map(F.lit, texts)), (F.col("event_id") % len(texts) + 1).cast("int"))
    return c.events.select("event_id", F.replace(picked, F.lit("{n}"), F.col("user_id").cast("string")).alias("t"))


def forms_sql(texts: list[str]) -> str:
    listed = ", ".join("'" + t.replace("'", "''") + "'" for t in texts)
    return f"(select event_id, replace([{listed}][event_id%{len(texts)}+1], '{{n}}', cast(user_id as varchar)) as t from events)"


@query(
    "c4_rate_parse",
    f"""select event_id, n as max_tokens, n/per as refill_rate from (select event_id, case when len(p)=2 and s is not null then try_cast(trim(p[1]) as double) end as n, s as per from (
          select event_id, p, case when trim(p[2]) in ('s', 'sec', 'second') then 1.0 when trim(p[2]) in ('m', 'min', 'minute') then 60.0 when trim(p[2]) in ('h', 'hr', 'hour') then 3600.0 end as s
          from (select event_id, string_split(t, '/') as p from {forms_sql(RATE_FORMS)})))""",
)
def rate_parse(c):
    return forms(c, RATE_FORMS).select("event_id", X.rate("t")["max_tokens"].alias("max_tokens"), X.rate("t")["refill_rate"].alias("refill_rate"))


UNIT = "(?i)^\\s*[0-9]+(?:\\.[0-9]+)?\\s*(ms|s|m|h|d)\\s*$"


@query(
    "c5_duration_parse",
    f"""select event_id, case when ms > 0 then ms end as ms from (select event_id, cast(round_even(cast(nullif(regexp_extract(t, '^\\s*([0-9]+(?:\\.[0-9]+)?)', 1), '') as double)
          * case lower(regexp_extract(t, '{UNIT}', 1)) when 'ms' then 1 when 's' then 1000 when 'm' then 60000 when 'h' then 3600000 when 'd' then 86400000 end, 0) as bigint) as ms from {forms_sql(DURATION_FORMS)})""",
)
def duration_parse(c):
    return forms(c, DURATION_FORMS).select("event_id", X.duration_ms("t").alias("ms"))


@query("c6_backoff", "select id, cast(least(1000.0*power(2.0, least(retry_count*5, 30)), 60000.0) as bigint) as delay, cast(coalesce(case retry_count when 0 then 10 when 1 then 20 end, least(1000.0*power(2.0, retry_count), 60000.0)) as bigint) as custom from jobs")
def backoff(c):
    return c.jobs.select("id", X.backoff_ms(F.col("retry_count") * 5, 1000, 60000).alias("delay"), X.backoff_ms("retry_count", 1000, 60000, [10, 20]).alias("custom"))


@query("c7_full_jitter")
def full_jitter(c):
    return c.jobs.select("id", X.full_jitter(X.backoff_ms("retry_count", 1000, 60000), 7).alias("delay"))


@query("c8_desync")
def desync(c):
    return c.jobs.select("id", X.desync("timeout_ms", 7).alias("delay"))


@query("c3_epoch_arithmetic", "select id, created_at+86400000 as later, scheduled_at-created_at as waited from jobs")
def epoch_arithmetic(c):
    most = F.lit(2**63 - 1)
    return c.jobs.select("id", F.coalesce(F.try_add("created_at", F.lit(86_400_000).cast("bigint")), most).alias("later"), F.try_subtract("scheduled_at", "created_at").alias("waited"))


@query("c9_idempotency_key", "select id, concat('auto:', substr(sha256(concat(task_name, chr(0), coalesce(metadata, ''))), 1, 32)) as key from jobs")
def idempotency_key(c):
    return c.jobs.select("id", X.idempotency_key("task_name", F.encode(F.coalesce("metadata", F.lit("")), "UTF-8")).alias("key"))


@query("c10_subscriber_key", "select topic, subscription_name, concat('k7', '::', cast(strlen(topic) as varchar), ':', cast(strlen(subscription_name) as varchar), ':', topic, subscription_name) as key from topic_subscriptions")
def subscriber_key(c):
    return c.topic_subscriptions.select("topic", "subscription_name", X.subscriber_key(F.lit("k7"), "topic", "subscription_name").alias("key"))


@query("c11_json_extract", "select id, metadata->>'$.k' as k, metadata->>'$.missing' as missing from topic_messages")
def json_extract(c):
    return c.topic_messages.select("id", F.get_json_object("metadata", "$.k").alias("k"), F.get_json_object("metadata", "$.missing").alias("missing"))


ERRORS = [
    "ValueError: bad {n}", "app.errors.TimeoutError: part: {n}", "Traceback\n  File x\nKeyError", "custom_thing : odd {n}", "no colon {n}", "", "  \n ", "note:",
    '{"errtype":"A","message":"m {n}","traceback":["l1","l2"]}', '{"message":""}', '{"errtype":"B","message":5}', '{broken: x}', "x\n\nDeprecationWarning: y\n",
]
ERRORS_SQL = forms_sql(ERRORS).replace("\n", "' || chr(10) || '")
LINES = f"""(select event_id, t, trim(regexp_extract(trim(t, concat(' ', chr(10))), '[^\\n]*$')) as line,
  case when t like '{{%' and try(json_type(t, '$.message'))='VARCHAR' then 1 else 0 end as structured from {ERRORS_SQL})"""
CLASS = """case when structured=1 then coalesce(t->>'$.errtype', 'Error') else coalesce(nullif(regexp_extract(line, '^([A-Za-z_][A-Za-z0-9_.]*(?:Error|Exception|Warning))(?::|$)', 1), ''),
  nullif(regexp_extract(line, '^([A-Za-z_][A-Za-z0-9_.]*)\\s*:', 1), ''), 'Error') end"""
REASON = """case when structured=1 then coalesce(nullif(t->>'$.message', ''), '(no error captured)') else coalesce(case when instr(line, ':') between 1 and length(line)-1
  then coalesce(nullif(trim(substr(line, instr(line, ':')+1)), ''), line) end, nullif(line, ''), '(no error captured)') end"""


@query("c13_exception_class", f"select event_id, {CLASS} as exception from {LINES}")
def exception_class(c):
    return forms(c, ERRORS).select("event_id", X.exception_class("t").alias("exception"))


@query("c14_error_reason", f"select event_id, {REASON} as reason from {LINES}")
def error_reason(c):
    return forms(c, ERRORS).select("event_id", X.error_reason("t").alias("reason"))


@query(
    "c15_structured_error",
    """select id, concat('{"errtype":"TimeoutError","message":"', m, '","traceback":["Traceback","', error, '"]}') as text, 'TimeoutError' as errtype, m as message, cast(2 as int) as frames
       from (select id, error, regexp_extract(error, '^[^:]*: *(.*)$', 1) as m from job_errors)""",
)
def structured_error(c):
    rows = c.job_errors.select("id", X.encode_error(X.exception_class("error"), X.error_reason("error"), F.array(F.lit("Traceback"), "error")).alias("text"))
    back = X.structured_error("text")
    return rows.select("id", "text", back["errtype"].alias("errtype"), back["message"].alias("message"), F.size(back["traceback"]).alias("frames"))


SPAN = "(case event_id%5 when 0 then event_id when 1 then event_id*13 when 2 then event_id*757 when 3 then (event_id%72)*125 else -event_id end)"
SECONDS = "floor(v/60000.0)"


@query(
    "c18_format_duration",
    f"""select event_id, case when v is null or v<0 then '\u2014' when v<1000 then concat(cast(v as varchar), 'ms')
       when v<10000 then concat(format('{{:.2f}}', case when v%125=0 then floor(v/10.0+0.5)/100 else v/1000.0 end), 's')
       when v<60000 then concat(format('{{:.1f}}', case when v%250=0 then floor(v/100.0+0.5)/10 else v/1000.0 end), 's')
       when v<3600000 then concat(cast(v//60000 as varchar), 'm ', cast(cast(floor(v/1000.0-60*(v//60000)+0.5) as bigint) as varchar), 's') else concat(cast(v//3600000 as varchar), 'h ', cast(v%3600000//60000 as varchar), 'm') end as text
       from (select event_id, case when event_id%11=0 then null else cast({SPAN} as bigint) end as v from events)""",
)
def format_duration(c):
    v = F.when(F.col("event_id") % 11 != 0, F.expr(SPAN))
    return c.events.select("event_id", X.format_duration(v).alias("text"))


KEPT = "(case event_id%7 when 0 then null when 1 then 0 when 2 then event_id*86400000 when 3 then event_id*3600000 when 4 then event_id*60000 when 5 then event_id%3000 else event_id*1000-500 end)"


@query(
    "c19_format_window",
    f"""select event_id, case when v is null then 'Kept forever' when v<=0 then 'Purged immediately' else concat(cast(n as varchar), ' ', unit, case when n=1 then '' else 's' end) end as text from (
          select event_id, v, case when v%86400000=0 then v//86400000 when v%3600000=0 then v//3600000 when v%60000=0 then v//60000 else greatest(1, (v+500)//1000) end as n,
            case when v%86400000=0 then 'day' when v%3600000=0 then 'hour' when v%60000=0 then 'minute' else 'second' end as unit
          from (select event_id, cast({KEPT} as bigint) as v from events))""",
)
def format_window(c):
    return c.events.select("event_id", X.format_window(F.expr(KEPT)).alias("text"))


@query("c20_cutoffs", f"select distinct result_ttl_ms, case when result_ttl_ms>=86400000*7 then {NOW_JOBS}-(result_ttl_ms-86400000*7) end as cutoff from jobs_all")
def cutoffs(c):
    return c.jobs_all.select("result_ttl_ms", X.cutoff(NOW_JOBS, F.col("result_ttl_ms") - 7 * 86_400_000).alias("cutoff")).distinct()


@query("c21_sojourn", "select id, greatest(852076800000-scheduled_at, 0) as sojourn from jobs where status=0")
def sojourn(c):
    return c.jobs.where("status = 0").select("id", X.sojourn(852076800000).alias("sojourn"))


@query("c22_round2", "select event_id, floor(value*100+0.5)/100 as v from events")
def round2(c):
    return c.events.select("event_id", X.round2(F.col("value")).alias("v"))


@query("c26_closed_set", "select event_id, event_type as kind from events")
def closed_set(c):
    return c.events.select("event_id", X.closed_set("event_type", ["signup", "error", "view", "click", "purchase"], "kind").alias("kind"))


@query("c25_hash")
def hash64(c):
    return c.jobs.select("id", F.xxhash64("id").alias("h"))


@query(
    "c1_next_cron",
    """select id, epoch_ms(d + to_days(case isodow(d) when 6 then 2 when 7 then 1 else 0 end)) as next_run from (
         select id, case when t < o then o else o + interval 1 day end as d from (select id, make_timestamp(created_at*1000) as t, date_trunc('day', make_timestamp(created_at*1000)) + interval 570 minute as o from workflow_runs))""",
)
def next_cron(c):
    return c.workflow_runs.select("id", U.next_cron_col(F.lit("0 30 9 * * MON-FRI"), F.col("created_at")).alias("next_run"))


@query("c2_next_cron_tz")
def next_cron_tz(c):
    return c.workflow_runs.select("id", U.next_cron_col(F.lit("0 30 2 * * *"), F.col("created_at"), "Europe/Berlin").alias("next_run"))


@query("r31_periodic_enqueue", "select concat('p', id) as id, cast(0 as int) as status, cast((903000000000//3600000+1)*3600000 as bigint) as next_run from workflow_runs where created_at <= 903000000000")
def periodic_enqueue(c):
    due = c.workflow_runs.where("created_at <= 903000000000")
    return due.select(F.concat(F.lit("p"), "id").alias("id"), F.lit(0).alias("status"), U.next_cron_col(F.lit("0 0 * * * *"), F.lit(903000000000)).alias("next_run"))


@query("c12_notes")
def notes(c):
    return c.topic_messages.select("id", U.canonical_notes(F.col("metadata")).alias("notes"))


@query("c24_fingerprint")
def fingerprint(c):
    return c.jobs.groupBy("queue").agg(F.array_sort(F.collect_set("task_name")).alias("names")).select("queue", U.registry_fingerprint(F.col("names")).alias("fingerprint"))


@query("c16_json_round_trip", "select id, cast(metadata->>'$.cust' as bigint) as cust from jobs where metadata is not null")
def json_round_trip(c):
    from opsloom.functions.codecs import from_envelope, to_envelope

    rows = c.jobs.where("metadata is not null").select("id", F.get_json_object("metadata", "$.cust").cast("bigint").alias("cust"))
    coded = rows.select("id", to_envelope(F.to_json(F.struct(F.array("cust").alias("args")))).alias("payload"))
    return coded.select("id", F.get_json_object(from_envelope(F.col("payload")), "$.args[0]").cast("bigint").alias("cust"))


@query("c17_codecs", "select id, metadata as back from topic_messages")
def codecs(c):
    packed = c.topic_messages.select("id", U.gzip_bytes(F.encode("metadata", "UTF-8")).alias("z"))
    sealed = packed.select("id", F.aes_encrypt("z", F.lit(b"0123456789abcdef"), F.lit("GCM")).alias("s"))
    return sealed.select("id", F.decode(U.gunzip_bytes(F.aes_decrypt("s", F.lit(b"0123456789abcdef"), F.lit("GCM"))), "UTF-8").alias("back"))


PADS = ["".join(f"\\x{b ^ pad:02X}" for b in b"key".ljust(64, b"\0")) for pad in (0x36, 0x5C)]


@query("c17_hmac", f"select id, sha256('{PADS[1]}'::blob || unhex(sha256('{PADS[0]}'::blob || encode(metadata)))) as mac from topic_messages")
def hmac(c):
    return c.topic_messages.select("id", U.hmac_hex(F.encode("metadata", "UTF-8"), b"key").alias("mac"))


@query("c23_url_parts", "select page_id, regexp_extract(url, '^[a-z]+://([^/]*)', 1) as host from pages")
def url_parts(c):
    return c.pages.select("page_id", F.try_parse_url("url", F.lit("HOST")).alias("host"))


@query("d1_task_function", "select event_id, concat(upper(event_type), '!') as out from events")
def task_function(c):
    tasks = U.Registry()
    tasks.task("shout", "string")(lambda text: text.upper() + "!")
    return c.events.select("event_id", tasks.apply("shout", F.col("event_type")).alias("out"))


@query(
    "d5_batched_items",
    "select event_id, case when value=6.55::double then 'error' else 'ok' end as status, case when value<>6.55::double then 1/(value-6.55::double) end as result, case when value=6.55::double then 'ValueError: nothing to divide by' end as error from events",
)
def batched_items(c):
    def invert(v):
        if v == 6.55:
            raise ValueError("nothing to divide by")
        return 1.0 / (v - 6.55)

    tasks = U.Registry()
    tasks.task("invert", "double")(invert)
    return tasks.apply_items(c.events, "invert", "event_id", "value")


@query("d6_starmap", "select event_id, concat(event_type, ':', cast(user_id%10 as varchar)) as out from events")
def starmap(c):
    tasks = U.Registry()
    tasks.task("label", "string")(lambda kind, n: f"{kind}:{n % 10}")
    return tasks.starmap(c.events.select("event_id", "event_type", "user_id"), "label", ["event_type", "user_id"], "out").select("event_id", "out")


@query("d12_resource", "select event_id, case event_type when 'click' then 3 when 'error' then 1 when 'purchase' then 5 when 'signup' then 4 else 2 end as weight from events")
def resource(c):
    """A table of weights that each worker process makes once."""
    weights = U.Resource("weights", lambda: {"error": 1, "view": 2, "click": 3, "signup": 4, "purchase": 5})
    return c.events.select("event_id", weights.apply(lambda table, kind: table[kind], "int", F.col("event_type")).alias("weight"))


# Predicates: action and seconds of each event.
AT = "select id, recorded_at as at_ms, succeeded, '{\"args\":[1,{\"k\":\"v\"}],\"kwargs\":{\"n\":3}}' as payload from task_metrics"
DOW = "(isodow(make_timestamp(at_ms*1000))-1)"
SEC = "(at_ms//1000%86400)"


def events_at(c):
    payload = F.lit('{"args":[1,{"k":"v"}],"kwargs":{"n":3}}')
    return c.task_metrics.select("id", F.col("recorded_at").alias("at_ms"), "succeeded", payload.alias("payload"))


def outcome(c, predicate):
    return events_at(c).withColumn("_p", predicate).select("id", F.col("_p.action").alias("action"), F.col("_p.seconds").alias("seconds"))


NONE = "cast(null as double) as seconds"
WEEKEND = f"case when {DOW}>=5 then 'run' else 'skip' end"


@query("f34_weekend", f"select id, {WEEKEND} as action, {NONE} from ({AT})")
def weekend(c):
    return outcome(c, P.parse('weekend(tz="UTC")'))


OPEN = f"({DOW}<5 and {SEC}>=32400 and {SEC}<61200)"
UNTIL = f"cast(case when {DOW}>=5 then 7-{DOW} when {SEC}<32400 then 0 else 1 end*86400+32400-{SEC} as double)"


@query("f33_business_hours", f"select id, case when {OPEN} then 'run' else 'defer' end as action, case when not {OPEN} then {UNTIL} end as seconds from ({AT})")
def business_hours(c):
    return outcome(c, P.business_hours())


@query("f35_time_window", f"select id, case when {SEC}>=79200 or {SEC}<21600 then 'run' else 'defer' end as action, case when {SEC}<79200 and {SEC}>=21600 then cast(79200-{SEC} as double) end as seconds from ({AT})")
def time_window(c):
    return outcome(c, P.parse('time_window("22:00", "06:00")'))


@query("f36_after", f"select id, case when at_ms>=1705000000000 then 'run' else 'defer' end as action, case when at_ms<1705000000000 then greatest(1.0, (1705000000000-at_ms)/1000.0) end as seconds from ({AT})")
def after(c):
    return outcome(c, P.parse("after(1705000000000)"))


@query("f37_before", f"select id, case when at_ms<1705000000000 then 'run' else 'skip' end as action, {NONE} from ({AT})")
def before(c):
    return outcome(c, P.parse("before(1705000000000)"))


@query("f38_in_timezone", f"select id, 'run' as action, {NONE} from ({AT})")
def in_timezone(c):
    return outcome(c, P.parse('in_timezone("Europe/Berlin")'))


@query("f32_payload", f"select id, case when succeeded then 'run' else 'skip' end as action, {NONE} from ({AT})")
def payload(c):
    return outcome(c, P.parse('payload_matches(path="args.1.k", equals="v") & payload_matches(path="kwargs.n", equals=3) & !payload_matches(path="args.9", equals=1) & flag_column("succeeded")'))


@query(
    "f28_and",
    f"select id, case when not {OPEN} then 'defer' when at_ms<1705000000000 then 'run' else 'skip' end as action, case when not {OPEN} then {UNTIL} end as seconds from ({AT})",
)
def predicate_and(c):
    return outcome(c, P.parse("business_hours() & before(1705000000000)"))


@query(
    "f29_or",
    f"select id, case when {OPEN} or {DOW}>=5 then 'run' else 'defer' end as action, case when not ({OPEN} or {DOW}>=5) then {UNTIL} end as seconds from ({AT})",
)
def predicate_or(c):
    return outcome(c, P.parse("business_hours() | weekend()"))


@query("f30_not", f"select id, case when {DOW}>=5 then 'skip' else 'run' end as action, {NONE} from ({AT})")
def predicate_not(c):
    return outcome(c, P.parse("!weekend()"))


@query("f31_callable", f"select id, case when at_ms%2=1 then 'run' else 'skip' end as action, {NONE} from ({AT})")
def predicate_callable(c):
    @F.pandas_udf("boolean")
    def odd(at):
        return at % 2 == 1

    return outcome(c, P.holds(odd("at_ms")))


@query("f39_flags", f"select id, case when succeeded then 'run' else 'skip' end as action, {NONE} from ({AT})")
def predicate_flags(c):
    """A flag of a provider that is on, one of the environment that isn't, and one that each row carries."""
    P.PROVIDERS["table"] = {"beta": True}.get
    return outcome(c, P.parse('feature_flag("beta", provider="table") & !feature_flag("of no environment") & flag_column("succeeded")'))
