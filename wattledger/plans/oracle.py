"""The catalog's results in SQL for DuckDB.

Written from the definitions, with regular expressions and CASE, not generated
from the operators, so that the two check each other.
"""

from __future__ import annotations


def _r(expr: str, decimals: int = 6) -> str:
    scale = f"1e{decimals}"
    return f"(floor(({expr}) * {scale} + 0.5017e0) / {scale})"


def _div(a: str, b: int) -> str:
    return f"cast((({a}) - ({a}) % {b}) / {b} as bigint)"


def _two(a: str) -> str:
    return f"lpad(cast({a} as string), 2, '0')"


def _hms(s: str) -> str:
    r = f"(({s}) % 86400)"
    clock = f"{_two(_div(r, 3600))} || ':' || {_two(_div(f'({r} % 3600)', 60))} || ':' || {_two(f'({r} % 60)')}"
    return f"(case when ({s}) >= 86400 then cast({_div(s, 86400)} as string) || '-' else '' end || {clock})"


_ORDERS = f"""
base as (
  select o_orderkey as k, o_custkey % 40 as u,
    case o_orderkey % 13 when 0 then 'FAILED' when 1 then 'TIMEOUT' when 2 then 'CANCELLED by 10001'
      when 3 then 'RUNNING' when 4 then 'PENDING' when 5 then 'OUT_OF_MEMORY' else 'COMPLETED' end as st,
    case when o_orderkey % 13 = 4 then 0 else o_orderkey * 7919 % 180000 end as w,
    1 + o_custkey % 32 as n, 1 + o_orderkey % 2 as nn,
    case when o_orderkey % 15 < 5 then cast(o_orderkey - o_orderkey % 5 as string) || '_' || cast(o_orderkey % 5 as string)
      else cast(o_orderkey as string) end as jid,
    case o_orderkey % 5 when 0 then 'gpu-a' when 1 then 'cpu-himem' else 'cpu-std' end as part,
    case when o_orderkey % 11 = 10 then null
      when o_orderkey % 4 = 0 then cast(2 + o_orderkey % 7 as string) || 'Gn'
      when o_orderkey % 4 = 1 then cast(1000 + o_orderkey % 3000 as string) || 'Mc'
      when o_orderkey % 4 = 2 then cast(8 + o_orderkey % 56 as string) || 'G'
      else cast(4000000 + o_orderkey % 9000 as string) || 'K' end as rm,
    cast(cast(o_orderdate as date) as string) as day,
    {_two('o_orderkey % 24')} || ':' || {_two('o_orderkey % 60')} as hm,
    o_orderpriority, lower(c_mktsegment) as account
  from orders join customer on o_custkey = c_custkey
),
per_order as (
  select *,
    case when k % 7 = 0 or w = 0 then '00:00:00' else {_hms(_div('w * n * (k % 90 + 10)', 100))} || '.508' end as tcpu,
    case when st = 'PENDING' then null else 'billing=' || cast(n as string) || ',cpu=' || cast(n as string)
      || case when part = 'gpu-a' then ',gres/gpu=' || cast(1 + k % 4 as string) else '' end
      || ',node=' || cast(nn as string) end as tres
  from base
),
step_rows as (
  select *, case l_linenumber when 1 then 'batch' when 2 then 'extern' end as step_name
  from lineitem join per_order on l_orderkey = k
  where st <> 'PENDING'
),
logs as (
  select cast(0 as bigint) as log_seq, cast(10000 + u as string) as UID, 'user' || cast(u as string) as "User", jid as JobID,
    'job-' || o_orderpriority as JobName, day || 'T' || hm || ':07' as Submit, {_hms('w')} as Elapsed,
    case when st = 'PENDING' then 'cpu-std,cpu-himem' else part end as "Partition",
    cast(nn as string) as NNodes, cast(n as string) as NCPUS, tcpu as TotalCPU, {_hms('w * n')} as CPUTime,
    rm as ReqMem, cast(null as string) as MaxRSS,
    '/home/user' || cast(u as string) || '/proj' || cast(k % 3 as string) as WorkDir,
    st as State, account as Account, tres as AllocTRES
  from per_order
  union all
  select cast(l_linenumber as bigint), null, null, jid || '.' || coalesce(step_name, cast(l_linenumber - 3 as string)),
    coalesce(step_name, 'step'), day || 'T' || hm || ':09', {_hms('w')}, null,
    cast(nn as string), cast(n as string), case when l_linenumber = 1 then tcpu else '00:00:00' end, {_hms('w * n')},
    rm,
    case when l_returnflag = 'N' then null when l_linenumber = 2 then '0'
      when l_suppkey % 9 = 0 then cast(l_partkey * 7919 % 20000000 as string)
      when l_suppkey % 9 = 1 then cast(l_partkey % 6000 as string) || 'M'
      else cast(l_partkey * 7919 % 20000000 as string) || 'K' end,
    null,
    case when st = 'RUNNING' then st when l_partkey % 50 = 0 then 'FAILED' else st end,
    account, tres
  from step_rows
)"""


def _ms(x: str) -> str:
    """Milliseconds of a duration text, NULL when unreadable."""
    def part(pattern: str) -> str:
        return f"coalesce(cast(nullif(regexp_extract({x}, '{pattern}', 1), '') as bigint), 0)"

    return (
        f"(case when regexp_matches({x}, '^([0-9]+-)?(([0-9]+:)?[0-9]+:)?[0-9]+([.][0-9]+)?$') then "
        f"{part('^([0-9]+)-')} * 86400000 + {part('([0-9]+):[0-9]+:[0-9]+([.][0-9]+)?$')} * 3600000 + "
        f"{part('([0-9]+):[0-9]+([.][0-9]+)?$')} * 60000 + {part('([0-9]+)([.][0-9]+)?$')} * 1000 + "
        f"{part('[.]([0-9]+)$')} end)"
    )


def _gb(value: str, unit: str) -> str:
    return f"case {unit} when 'G' then {value} when 'M' then {value} / 1e3 when 'K' then {value} / 1e6 end"


_NUMBER = r"([0-9]+[.]?[0-9]*|[.][0-9]+)"
_REQ_VALUE = f"cast(nullif(regexp_extract(ReqMem, '^{_NUMBER}[KMG][nc]?$', 1), '') as double)"
_REQ_TIMES = (
    "case right(ReqMem, 1) when 'n' then try_cast(NNodes as bigint) when 'c' then try_cast(NCPUS as bigint) else 1 end"
)
_REQ = (
    "case when ReqMem is null then 0e0 else "
    + _gb(f"({_REQ_VALUE} * {_REQ_TIMES})", f"regexp_extract(ReqMem, '^{_NUMBER}([KMG])[nc]?$', 2)")
    + " end"
)


def _rss(default_unit: str = "'K'") -> str:
    value = f"cast(nullif(regexp_extract(MaxRSS, '^{_NUMBER}[KMG]?$', 1), '') as double)"
    unit = f"coalesce(nullif(regexp_extract(MaxRSS, '([KMG])$', 1), ''), {default_unit})"
    return f"case when MaxRSS is null then -1e0 when MaxRSS = '0' then 0e0 else {_gb(value, unit)} end"


_GPUS = "coalesce(try_cast(nullif(regexp_extract(AllocTRES, 'gres/gpu=([0-9]+)', 1), '') as bigint), 0)"
_PART = """coalesce(split_part("Partition", ',', 1), '')"""
_SUBMIT = "try_strptime(Submit, '%Y-%m-%dT%H:%M:%S')"
_SINGLE = "split_part(JobID, '.', 1)"


def _state(custom: tuple[str, ...] = ()) -> str:
    own = f" when State in ({', '.join(repr(s) for s in custom)}) then -1" if custom else ""
    return (
        "cast(case when State in ('PD', 'PENDING', 'R', 'RUNNING', 'RQ', 'REQUEUED') then -2 "
        f"when State in ('CD', 'COMPLETED') then 1{own} else 0 end as integer)"
    )


def _steps(custom: tuple[str, ...] = (), logs: str = "logs", legacy: bool = False, extra: str = "", mixed: bool = False) -> str:
    by_hand = f"{_ms('Elapsed')} * try_cast(NCPUS as bigint)"
    core = f"case when g = 1 then {by_hand} else {_ms('CPUTime')} end" if mixed else f"{_ms('Elapsed')} * try_cast(NCPUS as bigint)" if legacy else _ms("CPUTime")
    gpus = "cast(0 as bigint)" if legacy else _GPUS
    account = "''" if legacy else "Account"
    return f"""
steps as (
  select log_seq, {_SINGLE} as single_jobID, {_REQ} as ReqMemX, {_rss()} as UsedMem_,
    {_ms('Elapsed')} as WallclockTimeX, {_ms('TotalCPU')} as TotalCPUtime_, {core} as CPUwallclocktime_,
    {gpus} as NGPUS_, {_PART} as PartitionX, {_SUBMIT} as SubmitDatetimeX,
    try_cast(NCPUS as bigint) as NCPUS_, try_cast(NNodes as bigint) as NNodes_, JobName as JobName_, WorkDir as WorkingDir_,
    UID as UIDX, "User" as UserX, {_state(custom)} as StateX, {account} as Account_{extra}
  from {logs}
)"""


def _first(c: str) -> str:
    return f"arg_min({c}, log_seq) filter (where {c} is not null) as {c}"


def _rolled(extra: str = "") -> str:
    largest = ("TotalCPUtime_", "CPUwallclocktime_", "WallclockTimeX", "ReqMemX", "UsedMem_", "NCPUS_", "NGPUS_", "NNodes_")
    return f"""
rolled as (
  select single_jobID, {', '.join(f'max({c}) as {c}' for c in largest)},
    min(SubmitDatetimeX) as SubmitDatetimeX, min(StateX) as StateX,
    {', '.join(_first(c) for c in ('JobName_', 'WorkingDir_', 'Account_', 'UIDX', 'UserX'))},
    coalesce(arg_min(PartitionX, log_seq) filter (where PartitionX <> ''), '') as PartitionX,
    count(nullif(PartitionX, '')) as n_partitions_, arg_max(PartitionX, log_seq) filter (where PartitionX <> '') as last_partition_{extra}
  from steps group by single_jobID
)"""


_PARTITIONS = """
partitions as (
  select * from (values
    ('cpu-std', 'CPU', 'standard nodes', 12e0, cast(null as string), cast(null as double)),
    ('cpu-himem', 'CPU', 'large-memory nodes', 15e0, null, null),
    ('gpu-a', 'GPU', 'accelerators', 300e0, 'standard nodes', 10e0)
  ) as t("partition", type, model, tdp, model_cpu, tdp_cpu)
)"""


def _jobs(legacy: bool = False, mixed: bool = False) -> str:
    untold = "and r.no_gpus" if mixed else ""
    gpus = f"case when p.type = 'GPU' {untold} then cast(1 as bigint) else r.NGPUS_ end" if legacy or mixed else "r.NGPUS_"
    return f"""
finished as (
  select r.* exclude (StateX, NGPUS_), cast(case when r.StateX = -1 then 1 else r.StateX end as integer) as StateX,
    {gpus} as NGPUS_, p.type as PartitionTypeX, p.tdp, p.tdp_cpu,
    case when UsedMem_ = -1 then ReqMemX else UsedMem_ end as UsedMem2_,
    split_part(single_jobID, '_', 1) as parentJobID
  from rolled r left join partitions p on r.PartitionX = p."partition" and r.n_partitions_ = 1
  where r.StateX <> -2
),
needed as (
  select *,
    case when ReqMemX < UsedMem2_ then (floor(UsedMem2_ / 6e0) + 1) * 6e0
      when ReqMemX is not null and UsedMem2_ is not null then least(ReqMemX, (floor(UsedMem2_ / 6e0) + 1) * 6e0) end as NeededMemX
  from finished
),
jobs as (
  select *,
    case when TotalCPUtime_ = 0 then CPUwallclocktime_ else TotalCPUtime_ end as TotalCPUtime2useX,
    case when PartitionTypeX = 'GPU' then WallclockTimeX * NGPUS_ else 0 end as TotalGPUtime2useX,
    case PartitionTypeX when 'CPU' then CPUwallclocktime_ / 3.6e6 when 'GPU' then 0e0 end as CPUhoursChargedX,
    case PartitionTypeX when 'GPU' then WallclockTimeX * NGPUS_ / 3.6e6 when 'CPU' then 0e0 end as GPUhoursChargedX,
    case when ReqMemX < NeededMemX then 1e0 when NeededMemX <> 0 then ReqMemX / NeededMemX end as memOverallocationFactorX
  from needed
)"""


_ENRICHED = """
energies as (
  select *,
    TotalCPUtime2useX / 1e3 / 3600e0 * case PartitionTypeX when 'CPU' then tdp else tdp_cpu end / 1e3 as energy_CPUs,
    TotalGPUtime2useX / 1e3 / 3600e0 * case PartitionTypeX when 'CPU' then 0e0 else tdp end / 1e3 as energy_GPUs,
    WallclockTimeX / 1e3 / 3600e0 * ReqMemX * 0.3725e0 / 1e3 as energy_memory,
    WallclockTimeX / 1e3 / 3600e0 * NeededMemX * 0.3725e0 / 1e3 as energy_memory_memoryNeededOnly
  from jobs
),
totals as (
  select *,
    (energy_CPUs + energy_GPUs + energy_memory) * 1.5e0 as energy,
    (energy_CPUs + energy_GPUs + energy_memory_memoryNeededOnly) * 1.5e0 as energy_memoryNeededOnly
  from energies
),
failed as (select *, case when StateX = 0 then energy else 0e0 end as energy_failedJobs from totals),
carbon as (
  select *, energy * 231.12e0 as carbonFootprint, energy_memoryNeededOnly * 231.12e0 as carbonFootprint_memoryNeededOnly,
    energy_failedJobs * 231.12e0 as carbonFootprint_failedJobs
  from failed
),
enriched as (
  select *, cast(SubmitDatetimeX as date) as SubmitDate,
    carbonFootprint / 917e0 as treeMonths, carbonFootprint_memoryNeededOnly / 917e0 as treeMonths_memoryNeededOnly,
    carbonFootprint_failedJobs / 917e0 as treeMonths_failedJobs,
    energy * 0.34e0 as cost, energy_memoryNeededOnly * 0.34e0 as cost_memoryNeededOnly, energy_failedJobs * 0.34e0 as cost_failedJobs,
    carbonFootprint / 175e0 as driving, carbonFootprint / 570000e0 as flying_NY_SF,
    carbonFootprint / 50000e0 as flying_PAR_LON, carbonFootprint / 2310000e0 as flying_NYC_MEL
  from carbon
)"""

_ENRICHED_NEW = (
    "energy_CPUs", "energy_GPUs", "energy_memory", "energy_memory_memoryNeededOnly", "energy", "energy_memoryNeededOnly",
    "energy_failedJobs", "carbonFootprint", "carbonFootprint_memoryNeededOnly", "carbonFootprint_failedJobs",
    "treeMonths", "treeMonths_memoryNeededOnly", "treeMonths_failedJobs", "cost", "cost_memoryNeededOnly", "cost_failedJobs",
    "driving", "flying_NY_SF", "flying_PAR_LON", "flying_NYC_MEL",
)

_JOB_COLUMNS = (
    "WallclockTimeX", "ReqMemX", "PartitionX", "SubmitDatetimeX", "StateX", "UIDX", "UserX", "PartitionTypeX",
    "TotalCPUtime2useX", "TotalGPUtime2useX", "CPUhoursChargedX", "GPUhoursChargedX", "NeededMemX", "memOverallocationFactorX",
)
_JOB_DOUBLES = ("ReqMemX", "CPUhoursChargedX", "GPUhoursChargedX", "NeededMemX", "memOverallocationFactorX")

# Summary column -> job column; whether the sum is of integers.
_INT_SUMS = {
    "cpuTime": "TotalCPUtime2useX", "gpuTime": "TotalGPUtime2useX", "wallclockTime": "WallclockTimeX", "n_success": "StateX",
}
_SUMS = {
    **{c: c for c in (
        "energy", "energy_CPUs", "energy_GPUs", "energy_memory", "carbonFootprint", "carbonFootprint_memoryNeededOnly",
        "carbonFootprint_failedJobs", "treeMonths", "treeMonths_memoryNeededOnly", "treeMonths_failedJobs", "driving",
        "flying_NY_SF", "flying_PAR_LON", "flying_NYC_MEL", "cost", "cost_failedJobs", "cost_memoryNeededOnly",
    )},
    "CPUhoursCharged": "CPUhoursChargedX", "GPUhoursCharged": "GPUhoursChargedX", "memoryRequested": "ReqMemX",
}
_SUMMARY_DOUBLES = (*_SUMS, "memoryOverallocationFactor", "success_rate", "failure_rate")
_SUMMARY_OTHERS = ("n_jobs", "first_job_period", "last_job_period", *_INT_SUMS)


def _summary(name: str, source: str, keys: tuple[str, ...], further: bool = False) -> str:
    def src(result: str, column: str) -> str:
        return result if further else column

    aggregates = [
        "cast(sum(n_jobs) as bigint) as n_jobs" if further else "count(UserX) as n_jobs",
        f"min({src('first_job_period', 'SubmitDatetimeX')}) as first_job_period",
        f"max({src('last_job_period', 'SubmitDatetimeX')}) as last_job_period",
        *[f"cast(sum({src(k, v)}) as {'bigint' if k == 'n_success' else 'decimal(38, 0)'}) as {k}" for k, v in _INT_SUMS.items()],
        *[f"sum({src(k, v)}) as {k}" for k, v in _SUMS.items()],
        f"avg({src('memoryOverallocationFactor', 'memOverallocationFactorX')}) as memoryOverallocationFactor",
    ]
    group = f"group by {', '.join(keys)}" if keys else ""
    head = f"{', '.join(keys)}, " if keys else ""
    return f"""
{name}_agg as (select {head}{', '.join(aggregates)} from {source} {group}),
{name} as (select *, n_success / nullif(n_jobs, 0) as success_rate, 1 - n_success / nullif(n_jobs, 0) as failure_rate from {name}_agg)"""


def _with(*ctes: str) -> str:
    return "with " + ",".join(ctes)


def _pick(table: str, plain=(), doubles=(), decimals: int = 6, where: str = "") -> str:
    columns = [*plain, *[f"{_r(c, decimals)} as {c}" for c in doubles]]
    return f"\nselect {', '.join(columns)} from {table} {where}"


_TO_JOBS = (_ORDERS, _steps(), _rolled(), _PARTITIONS, _jobs())
_TO_ENRICHED = (*_TO_JOBS, _ENRICHED)
_DAILY = _summary("daily", "enriched", ("UserX", "SubmitDate"))
_OVERALL = _summary("overall", "daily", ("UserX",), further=True)
_TO_DAILY = (*_TO_ENRICHED, _DAILY)
_TO_OVERALL = (*_TO_DAILY, _OVERALL)


def _over_logs(columns: str) -> str:
    return _with(_ORDERS) + f"\nselect {columns} from logs"


def _over_jobs(plain=(), doubles=(), decimals: int = 6, where: str = "") -> str:
    return _with(*_TO_JOBS) + _pick("jobs", plain, doubles, decimals, where)


# Report texts

def _fixed(x: str, decimals: int, commas: bool = True) -> str:
    return f"format('{{:{',' if commas else ''}.{decimals}f}}', {x})"


def _carbon_label(x: str, gas: str = "CO2e") -> str:
    return (
        f"case when {x} < 1e3 then {_fixed(x, 0)} || ' g{gas}' when {x} < 1e6 then {_fixed(f'({x}) / 1e3', 0)} || ' kg{gas}' "
        f"else {_fixed(f'({x}) / 1e6', 0)} || ' T{gas}' end"
    )


def _tree_label(x: str, split: bool) -> str:
    tm = f"cast(trunc({x}) as bigint)"
    rest = f" || ' and ' || cast({tm} % 12 as string) || ' tree-months'" if split else ""
    return (
        f"case when {tm} < 1 then {_fixed(x, 3, False)} || ' tree-months' when {tm} = 1 then {_fixed(x, 1, False)} || ' tree-month' "
        f"when {tm} < 6 then {_fixed(x, 1, False)} || ' tree-months' when {tm} <= 24 then cast({tm} as string) || ' tree-months' "
        f"when {tm} < 120 then cast({tm} // 12 as string) || ' tree-years'{rest} "
        f"else {_fixed(f'({x}) / 12e0', 1, False)} || ' tree-years' end"
    )


def _short_time(ms: str) -> str:
    s = f"({ms} / 1e3)"

    def unit(seconds: str, name: str, plural: bool = False) -> str:
        v = f"({s} / {seconds})"
        ending = "'s'" if plural else f"case when trunc({v}) = 1 then '' else 's' end"
        return f"{_fixed(v, 1, False)} || ' {name}' || {ending}"

    return (
        f"case when {s} >= 31536000 then {unit('31536000e0', 'year')} when {s} > 172800 then {unit('86400e0', 'day', True)} "
        f"when {s} >= 3600 then {unit('3600e0', 'hour')} else {_fixed(s, 2, False)} || ' seconds' end"
    )


def _by_trip(short: str, medium: str, far: str) -> str:
    return f"case when flying_NY_SF < 0.5 then {short} when flying_NYC_MEL < 0.5 then {medium} else {far} end"


def _flights(column: str, route: str) -> str:
    return f"regexp_replace({_fixed(column, 2)}, '([.][0-9])0$', '\\1') || ' flights between {route}'"


_LABELS = {
    "cpuTime": _short_time("cpuTime"),
    "gpuTime": _short_time("gpuTime"),
    "carbonFootprint": _carbon_label("carbonFootprint"),
    "carbonFootprint_failedJobs": _carbon_label("carbonFootprint_failedJobs"),
    "carbonFootprint_failedJobs_share": _fixed("carbonFootprint_failedJobs / carbonFootprint * 100", 2, False) + " || '%'",
    "carbonFootprint_wasted_memoryOverallocation": _carbon_label("(carbonFootprint - carbonFootprint_memoryNeededOnly)"),
    "share_carbonFootprint": "'100.00%'",
    "trees": _tree_label("treeMonths", False),
    "trees_split": _tree_label("treeMonths", True),
    "trees_failedJobs": _tree_label("treeMonths_failedJobs", True),
    "trees_wasted_memoryOverallocation": _tree_label("(treeMonths - treeMonths_memoryNeededOnly)", True),
    "driving": f"'driving ' || case when driving < 10 then {_fixed('driving', 2)} else {_fixed('driving', 0)} end || ' km'",
    "flying": _by_trip(
        _flights("flying_PAR_LON", "Paris and London"), _flights("flying_NY_SF", "New York and San Francisco"),
        _flights("flying_NYC_MEL", "New York and Melbourne"),
    ),
    "flying_number": _by_trip(*[f"cast({_fixed(c, 2, False)} as double)" for c in ("flying_PAR_LON", "flying_NY_SF", "flying_NYC_MEL")]),
    "flying_trip": _by_trip("'Paris - London'", "'New York - San Francisco'", "'New York - Melbourne'"),
    "cost": "'£' || " + _fixed("cost", 0),
    "cost_failedJobs": "'£' || " + _fixed("cost_failedJobs", 0),
    "cost_wasted_memoryOverallocation": "'£' || " + _fixed("cost - cost_memoryNeededOnly", 0),
    "n_jobs": "format('{:,}', n_jobs)",
    "failure_rate": _fixed("failure_rate * 100", 1, False) + " || '%'",
    "memoryOverallocationFactor": _fixed("memoryOverallocationFactor", 1),
}

# Logs of other shapes

_NUMBER_OF_JOB = "cast(replace(split_part(JobID, '.', 1), '_', '') as bigint)"
_MIXED = f"""
aged as (select *, ({_NUMBER_OF_JOB} + case when log_seq >= 2 then 1 else 0 end) % 3 as g from logs),
mixed as (
  select * replace (case when g <> 1 then CPUTime end as CPUTime, case when g <> 1 then AllocTRES end as AllocTRES,
    case when g <> 2 then Account end as Account)
  from aged
)"""
_SPREAD = f"""
spread as (
  select * replace (case when log_seq >= 2 and {_NUMBER_OF_JOB} % 9 in (4, 5) then
    cast(cast(substr(Submit, 1, 10) as date) + cast(case when {_NUMBER_OF_JOB} % 9 = 4 then 1 else -1 end * ({_NUMBER_OF_JOB} % 41) as integer) as string)
    || substr(Submit, 11) else Submit end as Submit)
  from logs
)"""


# Data quality

_DIRTY = """
cases as (
  select *, case when log_seq = 0 then j % 25 end as c
  from (select *, cast(replace(split_part(JobID, '.', 1), '_', '') as bigint) as j from logs)
),
dirty as (
  select log_seq,
    case when c in (13, 14) then null else UID end as UID,
    case when c = 14 then null else "User" end as "User",
    case when c = 18 then '1_' || JobID || '_2' else JobID end as JobID,
    JobName,
    -- see the partition of step rows below: jobs with two and more partition texts
    case c when 15 then '2022-02-30T00:00:00' when 16 then 'Unknown' else Submit end as Submit,
    case c when 9 then '1-2-3' when 10 then 'bad' when 11 then '1:2:3:4' when 4 then '00:10:00' else Elapsed end as Elapsed,
    case when c is null and j % 25 = 20 and log_seq = 1 then 'cpu-himem' when c is null and j % 25 = 21 then 'cpu-' || cast(log_seq as string)
      when c = 22 then 'cpu-' when c is null and j % 25 = 22 and log_seq = 1 then 'std'
      else case c when 4 then 'cpu-std,cpu-himem' when 5 then 'nope' when 6 then null when 7 then 'gpu-a' when 8 then 'cpu-std'
      else "Partition" end end as "Partition",
    NNodes, case when c = 17 then 'x' else NCPUS end as NCPUS,
    case when c = 12 then '900-00:00:00' else TotalCPU end as TotalCPU, CPUTime,
    case c when 2 then '12X' when 3 then '5Tn' else ReqMem end as ReqMem,
    case c when 0 then '5T' when 1 then '1.2.3K' else MaxRSS end as MaxRSS,
    WorkDir, State, case when j % 25 = 19 then null else Account end as Account,
    case c when 7 then 'billing=1,cpu=1,node=1' when 8 then 'cpu=1,gres/gpu=1' else AllocTRES end as AllocTRES
  from cases
)"""

_DIRTY_JOBS = (_ORDERS, _DIRTY, _steps(logs="dirty"), _rolled(), _PARTITIONS, _jobs())


def _violations(default_unit: bool) -> tuple[str, ...]:
    def unreadable(name: str, parsed: str) -> str:
        return f"case when ({parsed}) is null then '{name}=' || coalesce({name}, 'NULL') end"

    bad_unit = "regexp_matches(ReqMem, '^[0-9.]+[A-JLN-Za-z][nc]$') and not regexp_matches(ReqMem, '^[0-9.]+G[nc]$')"
    rows = {
        "R1": f"case when MaxRSS is not null and ({_rss()}) is null then 'MaxRSS=' || MaxRSS when {bad_unit} then 'ReqMem=' || ReqMem end",
        "R2": f"case when ({bad_unit}) is not true then {unreadable('ReqMem', _REQ.replace('try_cast(NNodes as bigint)', '1').replace('try_cast(NCPUS as bigint)', '1'))} end",
        "R4": f"""case when contains("Partition", ',') and {_ms('Elapsed')} > 0 then 'Partition=' || "Partition" end""",
        "R6": f"coalesce({', '.join(unreadable(n, _ms(n)) for n in ('Elapsed', 'TotalCPU', 'CPUTime'))})",
        "R13": unreadable("Submit", _SUBMIT),
        "R14": f"coalesce({unreadable('NNodes', 'try_cast(NNodes as bigint)')}, {unreadable('NCPUS', 'try_cast(NCPUS as bigint)')})",
    }
    if not default_unit:
        rows["R3"] = "case when regexp_matches(MaxRSS, '^[0-9.]+$') and MaxRSS <> '0' then 'MaxRSS=' || MaxRSS end"
    jobs = {
        "R5": "case when type is null then case when n_partitions_ > 1 then 'partitions=' || cast(n_partitions_ as string) "
        "|| ' first=' || PartitionX || ' last=' || last_partition_ else 'PartitionX=' || PartitionX end end",
        "R7": "case when TotalCPUtime_ > CPUwallclocktime_ then cast(TotalCPUtime_ as string) || ' > ' || cast(CPUwallclocktime_ as string) end",
        "R8": "case when type = 'GPU' and NGPUS_ = 0 and WallclockTimeX > 0 then 'GPUs=0' end",
        "R9": "case when type = 'CPU' and NGPUS_ <> 0 then 'GPUs=' || cast(NGPUS_ as string) end",
        "R10": "case when length(single_jobID) - length(replace(single_jobID, '_', '')) > 1 then 'JobID=' || single_jobID end",
        "R11": "case when UIDX is null or UserX is null then 'UID=' || coalesce(UIDX, 'NULL') || ' User=' || coalesce(UserX, 'NULL') end",
    }
    severity = {"R4": "warning", "R11": "warning"}
    extra = "".join(f", {text} as f_{rule}" for rule, text in rows.items())
    found = [
        f"select '{rule}' as rule, '{severity.get(rule, 'error')}' as severity, single_jobID as jobID, {text} as detail "
        f"from flagged {'' if rule in rows else 'where StateX <> -2'}"
        for rule, text in {**{r: f"f_{r}" for r in rows}, **jobs}.items()
    ]
    return (
        _ORDERS, _DIRTY, _steps(logs="dirty", extra=extra),
        _rolled("".join(f", min(f_{rule}) as f_{rule}" for rule in rows)), _PARTITIONS,
        '\nflagged as (select r.*, p.type from rolled r left join partitions p on r.PartitionX = p."partition" and r.n_partitions_ = 1)',
        f"\nviolations as (select * from ({' union all '.join(found)}) where detail is not null)",
    )


def oracle_sql() -> dict[str, str]:
    fields = 'log_seq, UID, "User", JobID, JobName, Submit, Elapsed, "Partition", NNodes, NCPUS, TotalCPU, CPUTime, ReqMem, ' \
        "MaxRSS, WorkDir, State, Account, AllocTRES"
    rolled_plain = (
        "single_jobID", "TotalCPUtime_", "CPUwallclocktime_", "WallclockTimeX", "NCPUS_", "NGPUS_", "NNodes_",
        "SubmitDatetimeX", "StateX", "JobName_", "WorkingDir_", "Account_", "UIDX", "UserX", "PartitionX",
        "n_partitions_", "last_partition_",
    )
    by_account = _summary("by_account", "enriched", ("Account_",))
    by_partition = _summary("by_partition", "enriched", ("PartitionX",))
    whole_daily = _summary("daily", "enriched", ("SubmitDate",))
    mixed = (
        _ORDERS, _MIXED, _steps(logs="mixed", mixed=True, extra=", g = 2 as no_account, g = 1 as no_gpus"),
        _rolled(", bool_and(no_account) as no_account, bool_and(no_gpus) as no_gpus"), _PARTITIONS, _jobs(mixed=True))
    spread = (_ORDERS, _SPREAD, _steps(logs="spread"), _rolled(), _PARTITIONS, _jobs())
    sets = {"UserX,SubmitDate": ("UserX", "SubmitDate"), "Account_": ("Account_",), "PartitionX": ("PartitionX",), "all": ()}
    set_rows = " union all ".join(
        "select '{}' as grouping, {}, {}, {}, {} as share_carbonFootprint from s{}".format(
            label, ", ".join(f"cast({k if k in keys else 'null'} as string) as {k}" for k in ("UserX", "SubmitDate", "Account_", "PartitionX")),
            ", ".join(_SUMMARY_OTHERS), ", ".join(f"{_r(c, 2)} as {c}" for c in _SUMMARY_DOUBLES),
            _r("carbonFootprint / (select carbonFootprint from s3)"), n)
        for n, (label, keys) in enumerate(sets.items()))
    table_rules = {
        "R5": "case when p.type is null or t.type is null or t.type <> p.type then 'PartitionX=' || t.PartitionX "
        "|| case when t.type <> p.type then ' PartitionTypeX=' || t.type else '' end end",
        "R8": "case when t.type = 'GPU' and coalesce(gpu, 0) = 0 and WallclockTimeX > 0 then 'TotalGPUtime2useX=' || coalesce(cast(gpu as string), 'NULL') end",
        "R9": "case when t.type = 'CPU' and gpu <> 0 then 'TotalGPUtime2useX=' || cast(gpu as string) end",
        "R11": "case when UIDX is null or UserX is null then 'UID=' || coalesce(UIDX, 'NULL') || ' User=' || coalesce(UserX, 'NULL') end",
    }
    cluster = f"case when {_NUMBER_OF_JOB} % 2 = 0 then 'north' else 'south' end"
    by_cluster = _with(
        _ORDERS, _steps(extra=f", {cluster} as Cluster").replace("''), 'K')", f"''), case when {cluster} = 'north' then 'K' else 'M' end)"),
        _rolled(", min(Cluster) as Cluster"), _PARTITIONS,
        _jobs().replace("p.tdp, p.tdp_cpu", "p.tdp * f as tdp, p.tdp_cpu * f as tdp_cpu, pue, ci, step, tariff")
        .replace("and r.n_partitions_ = 1", "and r.n_partitions_ = 1 and not (r.Cluster = 'south' and p.\"partition\" = 'cpu-himem') join sites using (Cluster)")
        .replace("6e0", "step").replace("\nfinished as", """
sites as (select * from (values ('north', 1e0, 1.5e0, 231.12e0, 6e0, 0.34e0), ('south', 2e0, 1.2e0, 52.5e0, 4e0, 0.21e0)) as t(Cluster, f, pue, ci, step, tariff)),
finished as"""),
        _ENRICHED.replace("1.5e0", "pue").replace("231.12e0", "ci").replace("0.34e0", "tariff"),
        _summary("daily", "enriched", ("Cluster", "UserX", "SubmitDate")))
    legacy = (_ORDERS, _steps(legacy=True), _rolled(), _PARTITIONS, _jobs(legacy=True))
    custom = (_ORDERS, _steps(("TIMEOUT", "OUT_OF_MEMORY")), _rolled(), _PARTITIONS, _jobs())
    split = "from overall"
    factor = _r("memOverallocationFactorX")
    efficiency_bin = "cast(least(floor(20e0 * (1e0 / memOverallocationFactorX * 100e0) / 100e0) + 1, 20) as integer)"
    ids = ", ".join(f"'{x}'" for x in ("15", "30", "45", "60", "75", "7", "1000"))
    overheads = "energy - energy_CPUs - energy_GPUs - energy_memory"
    tail2, tail1 = "right(Elapsed, 5)", "right(Elapsed, 2)"
    durations = {
        "elapsed_ms": "Elapsed", "total_cpu_ms": "TotalCPU", "cpu_time_ms": "CPUTime", "min_sec_ms": tail2, "sec_ms": tail1,
        "day_sec_ms": f"('3-' || {tail1})", "fraction_ms": f"({tail2} || '.508123')", "too_many_ms": "('1:' || Elapsed || ':2')",
        "two_days_ms": "('1-' || CPUTime)", "large_ms": f"('90000000' || {tail1} || ':05')", "long_fraction_ms": f"({tail1} || '.1300000000')",
    }
    wasted = {m: f"{m} - {m}_memoryNeededOnly" for m in ("carbonFootprint", "treeMonths", "cost")}

    hist = _with(*_TO_JOBS) + f"""
select UserX, bin, count(*) as n_jobs, (bin - 1) * 5e0 as bin_from, bin * 5e0 as bin_to
from (select UserX, {efficiency_bin} as bin from jobs where memOverallocationFactorX is not null) group by UserX, bin"""

    return {
        "scan_logs": _over_logs(fields),
        "legacy_logs": _with(*legacy) + _pick(
            "jobs", ("single_jobID", "CPUwallclocktime_", "NGPUS_", "Account_", "PartitionTypeX", "TotalGPUtime2useX"),
            ("CPUhoursChargedX", "GPUhoursChargedX"),
        ),
        "scan_mixed_logs": _with(_ORDERS, _MIXED) + f"""
select {fields}, case g when 0 then '' when 1 then 'CPUTime,AllocTRES' else 'Account' end as log_lacks, case when g = 2 then 'c1' end as Cluster from mixed""",
        "jobs_mixed_logs": _with(*mixed) + _pick(
            "jobs", ("single_jobID", "CPUwallclocktime_", "NGPUS_", "case when no_account then '' else Account_ end as Account_", "PartitionTypeX", "TotalGPUtime2useX"),
            ("CPUhoursChargedX", "GPUhoursChargedX"),
        ),
        "landed_period": _with(*spread) + _pick(
            "jobs", ("single_jobID", "SubmitDatetimeX", "WallclockTimeX", "TotalCPUtime2useX", "UserX"), ("UsedMem2_",), 9,
            "where SubmitDatetimeX >= timestamp '1996-03-01' and SubmitDatetimeX < timestamp '1997-07-01'",
        ),
        **{name: _with(_ORDERS, _steps(), _rolled()) + _pick("rolled", rolled_plain, ("ReqMemX", "UsedMem_"), 9)
           for name in ("rollup_incremental", "rollup_bucketed")},
        "dq_observed": _with(*_violations(default_unit=True)) + """
select rule, severity, count(*) as n_jobs from violations group by rule, severity""",
        "jobs_trusted": _with(*_violations(default_unit=True)[:4], *_violations(default_unit=True)[4:], _jobs()) + _pick(
            "jobs", ["single_jobID", *[c for c in _JOB_COLUMNS if c not in _JOB_DOUBLES]], _JOB_DOUBLES,
            where="where single_jobID not in (select jobID from violations where severity = 'error' and jobID is not null)"),
        "daily_from_table": _with(*_TO_DAILY) + _pick("daily", ("UserX", "SubmitDate", *_SUMMARY_OTHERS), _SUMMARY_DOUBLES),
        "summary_sets": _with(*_TO_ENRICHED, *[_summary(f"s{n}", "enriched", keys) for n, keys in enumerate(sets.values())]) + "\n" + set_rows,
        "dq_jobs": _with(*_DIRTY_JOBS, """
t as (
  select * exclude (PartitionTypeX), case when n % 25 = 3 then 1000 when n % 25 = 5 then 0 else TotalGPUtime2useX end as gpu,
    case when n % 50 = 1 then 'CPU' else PartitionTypeX end as type
  from (select *, cast(replace(single_jobID, '_', '') as bigint) as n from jobs)
)""") + "\nselect * from (" + " union all ".join(
            f"select '{rule}' as rule, '{'warning' if rule == 'R11' else 'error'}' as severity, single_jobID as jobID, {text} as detail "
            'from t left join partitions p on t.PartitionX = p."partition"' for rule, text in table_rules.items()) + ") where detail is not null",
        "jobs_from_table": _over_jobs([c for c in _JOB_COLUMNS if c not in _JOB_DOUBLES], _JOB_DOUBLES),
        "partition_dim": _with(_ORDERS, _PARTITIONS) + f"""
select p.*, u.n_rows from partitions p
join (select {_PART} as part, count(*) as n_rows from logs group by 1) u on p."partition" = u.part""",
        "parse_duration": _over_logs("JobID, log_seq, " + ", ".join(f"{_ms(t)} as {n}" for n, t in durations.items())),
        "req_mem": _over_logs(f"JobID, log_seq, ReqMem, {_r(_REQ, 9)} as ReqMemX"),
        "max_rss": _over_logs(f"JobID, log_seq, MaxRSS, {_r(_rss(), 9)} as UsedMem_"),
        "gpu_count": _over_logs(f"JobID, log_seq, {_GPUS} as NGPUS_"),
        "clean_partition": _over_logs(f"JobID, log_seq, {_PART} as PartitionX"),
        "submit_ts": _over_logs(f"JobID, log_seq, {_SUBMIT} as SubmitDatetimeX"),
        "state_code": _over_logs(f"JobID, log_seq, State, {_state()} as StateX"),
        "state_code_custom": _with(*custom) + _pick("jobs", ("single_jobID", "StateX")),
        "job_ids": _over_logs(f"JobID, log_seq, {_SINGLE} as single_jobID, split_part({_SINGLE}, '_', 1) as parentJobID"),
        "job_rollup": _with(_ORDERS, _steps(), _rolled()) + _pick("rolled", rolled_plain, ("ReqMemX", "UsedMem_"), 9),
        "finished_jobs": _over_jobs(("single_jobID", "StateX", "UserX")),
        "partition_type": _over_jobs(("single_jobID", "PartitionX", "PartitionTypeX", "tdp", "tdp_cpu")),
        "cpu_gpu_time": _over_jobs(("single_jobID", "TotalCPUtime2useX", "TotalGPUtime2useX")),
        "core_hours": _over_jobs(("single_jobID",), ("CPUhoursChargedX", "GPUhoursChargedX")),
        "mem_needed": _over_jobs(("single_jobID",), ("ReqMemX", "UsedMem2_", "NeededMemX"), 9),
        "mem_overalloc": _over_jobs(("single_jobID",), ("memOverallocationFactorX",)),
        "jobs": _over_jobs([c for c in _JOB_COLUMNS if c not in _JOB_DOUBLES], _JOB_DOUBLES),
        "energy": _with(*_TO_ENRICHED) + _pick(
            "enriched", ("single_jobID",), [c for c in _ENRICHED_NEW if c.startswith("energy") and c != "energy_failedJobs"]
        ),
        "enriched": _with(*_TO_ENRICHED) + _pick("enriched", ("single_jobID", "SubmitDate"), _ENRICHED_NEW),
        "period_filter": _over_jobs(
            ("single_jobID", "SubmitDatetimeX"),
            where="where SubmitDatetimeX >= timestamp '1996-03-01' and SubmitDatetimeX < timestamp '1997-07-01'",
        ),
        "filter_workdir": _over_jobs(("single_jobID", "WorkingDir_"), where="where WorkingDir_ = '/home/user7/proj1'"),
        "filter_job_ids": _over_jobs(("single_jobID", "parentJobID", "UserX"), where=f"where parentJobID in ({ids})"),
        "filter_job_ids_semi": _over_jobs(
            ("single_jobID", "parentJobID", "UserX"),
            where="where parentJobID in (select cast(o_orderkey as string) from orders where o_orderpriority = '1-URGENT')",
        ),
        "filter_account": _over_jobs(("single_jobID", "Account_"), where="where Account_ = 'machinery'"),
        "daily": _with(*_TO_DAILY) + _pick("daily", ("UserX", "SubmitDate", *_SUMMARY_OTHERS), _SUMMARY_DOUBLES),
        "daily_by_cluster": by_cluster + _pick("daily", (
            "Cluster", "UserX", "SubmitDate", *_SUMMARY_OTHERS,
            f"{_r('carbonFootprint / sum(carbonFootprint) over (partition by Cluster, UserX)')} as share_carbonFootprint"), _SUMMARY_DOUBLES),
        "overall": _with(*_TO_OVERALL) + _pick("overall", ("UserX", *_SUMMARY_OTHERS), _SUMMARY_DOUBLES, 3),
        "by_account": _with(*_TO_ENRICHED, by_account) + _pick("by_account", ("Account_", *_SUMMARY_OTHERS), _SUMMARY_DOUBLES, 3),
        "by_partition": _with(*_TO_ENRICHED, by_partition) + _pick(
            "by_partition", ("PartitionX", *_SUMMARY_OTHERS), _SUMMARY_DOUBLES, 3
        ),
        "whole_set": _with(*_TO_ENRICHED, whole_daily, _summary("whole", "daily", (), further=True)) + _pick(
            "whole", _SUMMARY_OTHERS, _SUMMARY_DOUBLES, 2
        ),
        "share": _with(*_TO_DAILY) + f"""
select UserX, SubmitDate, {_r('carbonFootprint / sum(carbonFootprint) over (partition by UserX)')} as share_carbonFootprint
from daily""",
        "share_by_account": _with(*_TO_ENRICHED, by_account) + _pick("by_account", (
            "Account_", *_SUMMARY_OTHERS, f"{_r('carbonFootprint / sum(carbonFootprint) over ()')} as share_carbonFootprint"), _SUMMARY_DOUBLES, 3),
        "factor_lists": _with(*_TO_JOBS) + f"""
select scope, UserX, {_r('factor')} as memOverallocationFactorX, count(*) as n_jobs from (
  select 'user' as scope, UserX, {factor} as factor from jobs where UserX is not null
  union all select 'overall', null, {factor} from jobs)
group by all""",
        "mem_efficiency_hist": hist,
        "mem_efficiency_of_days": hist,
        # Jobs by falling efficiency bin: the bin of the job whose rank is the quantile's, and its place in the bin.
        "factor_quantiles": _with(*_TO_JOBS, f"""
placed as (
  select UserX, bin, row_number() over (partition by UserX order by bin desc) as r, count(*) over (partition by UserX) as n,
    row_number() over (partition by UserX, bin order by single_jobID) as within, count(*) over (partition by UserX, bin) as m
  from (select UserX, single_jobID, {efficiency_bin} as bin from jobs where memOverallocationFactorX is not null)
)""") + f"""
select UserX, q as quantile, n as n_jobs, {_r('100e0 / (bin * 5e0 - 5e0 * (ceil(q * n) - (bin_end - m) - 0.5e0) / m)')} as factor,
  {_r('100e0 / (bin * 5e0)')} as factor_low, {_r('100e0 / nullif((bin - 1) * 5e0, 0)')} as factor_high
from (select distinct UserX, bin, n, m, max(r) over (partition by UserX, bin) as bin_end from placed), (values (0.25e0), (0.5e0), (0.9e0), (1e0)) as t(q)
where ceil(q * n) <= bin_end and ceil(q * n) > bin_end - m""",
        "daily_rates_long": _with(*_TO_DAILY) + f"""
select UserX, SubmitDate, 'failure_rate' as variable, {_r('failure_rate')} as value from daily
union all select UserX, SubmitDate, 'success_rate', {_r('success_rate')} from daily""",
        "success_split": _with(*_TO_OVERALL) + f"""
select UserX, 'Success' as Status, n_success as n_jobs {split}
union all select UserX, 'Failure', n_jobs - n_success {split}""",
        "daily_series": _with(*_TO_DAILY) + _pick(
            "daily", ("UserX", "SubmitDate", "n_jobs"), ("carbonFootprint", "CPUhoursCharged", "memoryRequested")
        ),
        "energy_breakdown": _with(*_TO_OVERALL) + f"""
select UserX, {', '.join(f'{_r(c, 4)} as {c}' for c in ('energy', 'energy_CPUs', 'energy_GPUs', 'energy_memory'))},
  {_r(overheads, 4)} as energy_overheads,
  {', '.join(f'{_r(c + " / energy", 4)} as share_{c}' for c in ('energy_CPUs', 'energy_GPUs', 'energy_memory'))},
  {_r(f'({overheads}) / energy', 4)} as share_energy_overheads
from overall""",
        "waste": _with(*_TO_OVERALL) + f"""
select UserX, {', '.join(f'{_r(c, 3)} as {c}' for c in (
    'failure_rate', 'carbonFootprint_failedJobs', 'treeMonths_failedJobs', 'cost_failedJobs', 'memoryOverallocationFactor'))},
  {_r('carbonFootprint_failedJobs / carbonFootprint', 3)} as carbonFootprint_failedJobs_share,
  {', '.join(f'{_r(x, 3)} as {m}_wasted_memoryOverallocation' for m, x in wasted.items())}
from overall""",
        "usage_summary": _with(*_TO_OVERALL) + f"""
select UserX, cast(first_job_period as date) as first_job_date, cast(last_job_period as date) as last_job_date, n_jobs, n_success,
  cpuTime, gpuTime, wallclockTime, {_r('cpuTime / 3.6e6', 3)} as cpuHours, {_r('gpuTime / 3.6e6', 3)} as gpuHours,
  {_r('CPUhoursCharged', 3)} as CPUhoursCharged, {_r('GPUhoursCharged', 3)} as GPUhoursCharged,
  {_r('CPUhoursCharged + GPUhoursCharged', 3)} as hoursCharged, {_r('memoryRequested', 3)} as memoryRequested
from overall""",
        "labels": _with(*_TO_OVERALL) + f"\nselect UserX, {', '.join(f'{x} as {c}' for c, x in _LABELS.items())} from overall",
        "labels_html": _with(*_TO_OVERALL) + "\nselect UserX, " + ", ".join(
            f"{_carbon_label(x, 'CO<sub>2</sub>e')} as {c}" for c, x in {
                "carbonFootprint": "carbonFootprint", "carbonFootprint_failedJobs": "carbonFootprint_failedJobs",
                "carbonFootprint_wasted_memoryOverallocation": "(carbonFootprint - carbonFootprint_memoryNeededOnly)",
            }.items()) + " from overall",
        "dq_violations": _with(*_violations(default_unit=False)) + """
select rule, severity, jobID, detail from violations
union all select 'R12', 'info', null, 'users=' || cast(count(distinct UserX) as string) from rolled where StateX <> -2
having count(distinct UserX) > 1""",
        "dq_by_rule": _with(*_violations(default_unit=True)) + """
select rule, severity, count(*) as n_jobs from violations group by rule, severity""",
        "daily_dirty": _with(*_DIRTY_JOBS, _ENRICHED, _DAILY) + _pick("daily", ("UserX", "SubmitDate", *_SUMMARY_OTHERS), _SUMMARY_DOUBLES),
        "overall_dirty": _with(*_DIRTY_JOBS, _ENRICHED, _DAILY, _OVERALL) + _pick("overall", ("UserX", *_SUMMARY_OTHERS), _SUMMARY_DOUBLES, 3),
        "by_account_dirty": _with(*_DIRTY_JOBS, _ENRICHED, by_account) + _pick("by_account", ("Account_", *_SUMMARY_OTHERS), _SUMMARY_DOUBLES, 3),
        "rollup_dirty": _with(_ORDERS, _DIRTY, _steps(logs="dirty"), _rolled()) + _pick("rolled", rolled_plain, ("ReqMemX", "UsedMem_"), 9),
        "dq_summary": _with(*_DIRTY_JOBS) + """
select count(*) as n_jobs, count(distinct UserX) as n_users, count(*) filter (where UIDX is null) as n_missing_uid,
  count(*) filter (where UserX is null) as n_missing_user, cast(count(distinct UserX) > 1 as integer) as several_users
from jobs""",
    }
