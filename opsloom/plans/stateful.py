"""Registered ordered state machines over `submissions`."""

from opsloom.operators import stateful as S
from opsloom.plans.registry import query

RANKED = "ranked as (select seq, key, at_ms, failed, sojourn_ms, row_number() over (partition by key order by at_ms, seq) as n from submissions)"
BUCKET = """with recursive {ranked}, fold as (
  select seq, key, at_ms, n, cast({most} as double) >= 1 as allowed, cast({most} as double) - 1 as tokens from ranked where n=1
  union all select r.seq, r.key, r.at_ms, r.n, least({most}, f.tokens+(r.at_ms-f.at_ms)/1000.0*{refill}) >= 1,
    least({most}, f.tokens+(r.at_ms-f.at_ms)/1000.0*{refill}) - case when least({most}, f.tokens+(r.at_ms-f.at_ms)/1000.0*{refill}) >= 1 then 1 else 0 end
  from fold f join ranked r on r.key=f.key and r.n=f.n+1)
  select seq, key, allowed from fold"""


@query("r4_token_bucket", BUCKET.format(ranked=RANKED, most="3.0", refill="0.0001"))
def token_bucket(c):
    return S.token_bucket(c.submissions, 3.0, 0.0001)


@query("r10_retry_budget", BUCKET.format(ranked=RANKED.replace("from submissions", "from submissions where failed"), most="2.0", refill="0.00001"))
def retry_budget(c):
    return S.token_bucket(c.submissions.where("failed"), 2.0, 0.00001)


CHAIN = "with recursive {ranked}, {body}"


@query(
    "r3_debounce",
    CHAIN.format(
        ranked=RANKED,
        body="""fold as (select key, seq, at_ms, n, at_ms as first, at_ms+600000 as deadline, cast(1 as bigint) as c from ranked where n=1
  union all select r.key, r.seq, r.at_ms, r.n, case when r.at_ms < f.deadline then f.first else r.at_ms end,
    case when r.at_ms < f.deadline then least(r.at_ms+600000, f.first+1800000) else least(r.at_ms+600000, r.at_ms+1800000) end, case when r.at_ms < f.deadline then f.c+1 else 1 end
  from fold f join ranked r on r.key=f.key and r.n=f.n+1)
  select key, first as first_seen, max_by(deadline, n) as fires_at, max(c) as n, max_by(seq, n) as last_seq from fold group by key, first""",
    ),
)
def debounce(c):
    return S.debounce(c.submissions, 600_000, 1_800_000)


@query(
    "r30_batch_accumulator",
    CHAIN.format(
        ranked=RANKED,
        body="""fold as (select key, seq, at_ms, n, at_ms as first, seq as first_seq, cast(1 as bigint) as c from ranked where n=1
  union all select r.key, r.seq, r.at_ms, r.n, case when f.c>=4 or r.at_ms >= f.first+7200000 then r.at_ms else f.first end,
    case when f.c>=4 or r.at_ms >= f.first+7200000 then r.seq else f.first_seq end, case when f.c>=4 or r.at_ms >= f.first+7200000 then 1 else f.c+1 end
  from fold f join ranked r on r.key=f.key and r.n=f.n+1)
  select key, first_seq, max(c) as n, case when max(c)>=4 then max(at_ms) else max(first)+7200000 end as flushed_at from fold group by key, first_seq""",
    ),
)
def batch_accumulator(c):
    return S.accumulate(c.submissions, 4, 7_200_000)


# The breaker, a step a row: what it is before the row (m, tried, good, bad), whether the row passes, and what it is after.
BREAKER = """with recursive {ranked}, fold as (
  select key, cast(0 as bigint) as seq, cast(0 as bigint) as n, false as allowed, 'closed' as mode, 0 as failures, cast(null as bigint) as last, cast(0 as bigint) as opened,
    cast(0 as bigint) as half, 0 as tried, 0 as good, 0 as bad from (select distinct key from ranked)
  union all select key, seq, n, pass, case when out_mode='tried' then m else out_mode end, case when out_mode='closed' and not (m='closed' and failed) then 0 when pass and failed then fails else failures end,
    case when pass and failed then at_ms else last end, case when out_mode='open' and m<>'open' then at_ms else opened end, case when enter then at_ms else half end,
    case when out_mode in ('open', 'closed') then 0 else tried end, case when out_mode in ('open', 'closed') then 0 else good end, case when out_mode in ('open', 'closed') then 0 else bad end
  from (select *, case when not pass then case when m='half_open' and at_ms-half >= {cooldown} then 'open' else m end
      when m='closed' then case when failed and fails >= {threshold} then 'open' else 'closed' end
      when not failed and good+bad >= {probes} and cast(good as double)/(good+bad) >= {rate} then 'closed'
      when good+bad >= {probes} or (failed and cast(good+{probes}-good-bad as double)/{probes} < {rate}) then 'open' else 'tried' end as out_mode
    from (select *, case when m='closed' and (last is null or at_ms-last > {window}) then 1 else failures+1 end as fails
      from (select r.key, r.seq, r.n, r.at_ms, r.failed, f.failures, f.last, f.opened, f.half, f.mode='open' and r.at_ms-f.opened >= {cooldown} as enter,
          case when f.mode='open' and r.at_ms-f.opened >= {cooldown} then 'half_open' else f.mode end as m,
          f.mode='closed' or (f.mode='open' and r.at_ms-f.opened >= {cooldown}) or (f.mode='half_open' and f.tried < {probes}) as pass,
          f.tried + case when f.mode='half_open' and f.tried < {probes} then 1 else 0 end as tried,
          f.good + case when not r.failed and (f.mode='open' and r.at_ms-f.opened >= {cooldown} or f.mode='half_open' and f.tried < {probes}) then 1 else 0 end as good,
          f.bad + case when r.failed and (f.mode='open' and r.at_ms-f.opened >= {cooldown} or f.mode='half_open' and f.tried < {probes}) then 1 else 0 end as bad
        from fold f join ranked r on r.key=f.key and r.n=f.n+1))))
  select {what} from fold where n > 0 {rest}"""
ROWS = "seq, key, allowed, mode"


@query("r5_circuit_breaker", BREAKER.format(ranked=RANKED, threshold=3, window=7_200_000, cooldown=3_600_000, probes=2, rate=1.0, what=ROWS, rest=""))
def circuit_breaker(c):
    return S.breaker(c.submissions, threshold=3, window_ms=7_200_000, cooldown_ms=3_600_000, probes=2, close_rate=1.0)


@query("r6_breaker_recovery", BREAKER.format(ranked=RANKED, threshold=2, window=86_400_000, cooldown=1_800_000, probes=5, rate=0.6, what=ROWS, rest="and (mode='half_open' or not allowed)"))
def breaker_recovery(c):
    return S.breaker(c.submissions, threshold=2, window_ms=86_400_000, cooldown_ms=1_800_000, probes=5, close_rate=0.6).where("mode = 'half_open' or not allowed")


@query("r7_breaker_trips", BREAKER.format(ranked=RANKED, threshold=2, window=3_600_000, cooldown=3_600_000, probes=5, rate=0.8, what="key, mode, count(*) as count", rest="group by key, mode"))
def breaker_trips(c):
    return S.breaker(c.submissions, threshold=2, window_ms=3_600_000, cooldown_ms=3_600_000).groupBy("key", "mode").count()


CODEL = """with recursive {ranked}, fold as (
  select key, cast(0 as bigint) as seq, cast(0 as bigint) as n, false as shed, cast(0 as bigint) as above, cast(0 as bigint) as next, 0 as c, false as dropping from (select distinct key from ranked)
  union all select key, seq, n, drop, case when low then 0 when above=0 then at_ms+{interval} else above end, case when drop then at_ms+greatest(1, cast(trunc({interval}/sqrt(greatest(k, 1))) as bigint)) else next end,
    case when drop then k else c end, case when low then false when drop then true else dropping end
  from (select *, not low and above<>0 and at_ms>=above and (not dropping or at_ms>=next) as drop, case when dropping then c+1 when c>2 and at_ms-next < 8*{interval} then c-2 else 1 end as k
    from (select r.key, r.seq, r.n, r.at_ms, r.sojourn_ms < {target} as low, f.above, f.next, f.c, f.dropping from fold f join ranked r on r.key=f.key and r.n=f.n+1)))
  select {what} from fold {rest}"""


@query("r8_codel", CODEL.format(ranked=RANKED, target=3000, interval=1_800_000, what="seq, key, shed", rest="where n > 0"))
def codel(c):
    return S.codel(c.submissions, 3000, 1_800_000)


@query("r9_codel_admit", CODEL.format(ranked=RANKED, target=3000, interval=1_800_000, what="s.seq, s.key, s.at_ms, s.failed, s.sojourn_ms", rest="f join ranked s on s.key=f.key and s.n=f.n where not shed"))
def codel_admit(c):
    kept = S.codel(c.submissions, 3000, 1_800_000).where("not shed").select("seq")
    return c.submissions.join(kept, "seq", "left_semi")
