"""SQL expressions that read the text fields of an accounting log.

Every function takes and returns the text of a Spark SQL expression, for
``selectExpr`` and ``expr``: a log has many fields, and one parsed text per field
builds a plan much faster than one call into the JVM per operation. Built from
Spark's own functions only. Text that cannot be read becomes NULL;
operators.quality reports it. A failing ``try_cast`` is costly, so texts that are
regularly no number (an empty match, a missing part) never get there.
"""

from __future__ import annotations

from collections.abc import Sequence

from .sql import quoted, string

# Texts that stand for a missing value in a delimited log.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Scheduler states and the code of each group.
SUCCESS_STATES = ("CD", "COMPLETED")
UNFINISHED_STATES = ("PD", "PENDING", "R", "RUNNING", "RQ", "REQUEUED")
STATE_UNFINISHED, STATE_CUSTOM_SUCCESS, STATE_FAILED, STATE_SUCCESS = -2, -1, 0, 1

# Marks "memory use not logged" up to and including the roll-up to jobs.
RSS_NOT_LOGGED = -1.0

_SUBMIT = "^[0-9]{4}+-[0-9]{1,2}+-[0-9]{1,2}+T[0-9]{1,2}+:[0-9]{1,2}+:[0-9]{1,2}+$"
_REQUEST = "^[0-9.]++[KMG][nc]?+$"
_MEMORY_USE = "^[0-9.]++[KMG]?+$"


def null_if_na(text: str) -> str:
    """NULL for the texts that stand for a missing value, else the text itself."""
    return f"CASE WHEN {text} NOT IN ({quoted(NA_TOKENS)}) THEN {text} END"


def integer(text: str) -> str:
    """BIGINT, NULL when the text is no integer."""
    return f"try_cast({text} AS BIGINT)"


def duration_ms(text: str) -> str:
    """Milliseconds of ``[D-][[HH:]MM:]SS[.f]``.

    Parts may exceed 59. ``f`` is a whole number of milliseconds however many
    digits it has. A part that is no integer, one part too many, or a result
    beyond a BIGINT makes the result NULL.

    This is the inner loop of reading a log, so the text is cut by plain
    substrings, which cost a fraction of a regular expression. The cuts are used
    in places that are always evaluated, where Spark computes each only once.
    Parts of a text with too many separators do not add up to its length, which
    is how such a text is recognised.
    """
    time = f"substring_index({text}, '-', -1)"
    clock = f"substring_index({time}, '.', 1)"
    tail = f"substring_index({clock}, ':', -2)"
    sec = f"substring_index({clock}, ':', -1)"

    def longer(a: str, b: str) -> str:
        return f"octet_length({a}) > octet_length({b})"

    # Part, whether it is there, and its weight in ms.
    parts = (
        (f"substring_index({text}, '-', 1)", longer(text, time), 86_400_000),
        (f"substring_index({clock}, ':', 1)", longer(clock, tail), 3_600_000),
        (f"substring_index({tail}, ':', 1)", longer(tail, sec), 60_000),
        (f"substring_index({time}, '.', -1)", longer(time, clock), 1),
    )
    total = f"try_multiply(try_cast({sec} AS BIGINT), 1000L)"
    length = f"octet_length({sec})"
    for part, present, weight in parts:
        total = f"try_add({total}, CASE WHEN {present} THEN try_multiply(try_cast({part} AS BIGINT), {weight}L) ELSE 0L END)"
        length += f" + CASE WHEN {present} THEN octet_length({part}) + 1 ELSE 0 END"
    return f"CASE WHEN octet_length({text}) = {length} THEN {total} END"


def _gb(value: str, unit: str) -> str:
    return f"CASE {unit} WHEN 'G' THEN {value} WHEN 'M' THEN {value} / 1e3D WHEN 'K' THEN {value} / 1e6D END"


def requested_memory_gb(text: str, nodes: str, cores: str) -> str:
    """GB of a memory request: ``8G`` in all, ``250Gn`` per node, ``6760Mc`` per core.

    A request that is not logged counts as 0.
    """
    last = f"right({text}, 1)"
    tail = f"CASE WHEN {last} IN ('n', 'c') THEN 2 ELSE 1 END"
    unit = f"substring({text}, -{tail}, 1)"
    value = (
        f"try_cast(CASE WHEN {text} RLIKE {string(_REQUEST)} THEN substring({text}, 1, length({text}) - {tail}) END AS DOUBLE)"
    )
    times = f"CASE {last} WHEN 'n' THEN {nodes} WHEN 'c' THEN {cores} ELSE 1L END"
    return f"CASE WHEN {text} IS NULL THEN 0D ELSE {_gb(f'({value} * {times})', unit)} END"


def max_rss_gb(text: str, default_unit: str | None) -> str:
    """GB of a memory use such as ``2745K``; a bare number is in ``default_unit``.

    Not logged gives RSS_NOT_LOGGED. Without a default unit a bare number is
    unreadable, except for 0.
    """
    last = f"right({text}, 1)"
    has_unit = f"{last} IN ('K', 'M', 'G')"
    bare = f"CASE WHEN {has_unit} THEN substring({text}, 1, length({text}) - 1) ELSE {text} END"
    value = f"try_cast(CASE WHEN {text} RLIKE {string(_MEMORY_USE)} THEN {bare} END AS DOUBLE)"
    unit = f"CASE WHEN {has_unit} THEN {last} ELSE {string(default_unit)} END"
    return (
        f"CASE WHEN {text} IS NULL THEN {RSS_NOT_LOGGED}D WHEN {text} = '0' THEN 0D "
        f"ELSE {_gb(value, unit)} END"
    )


def gpu_count(resources: str) -> str:
    """Number of GPUs in an allocation text; typed entries (``gres/gpu:a100=4``) do not count."""
    digits = f"nullif(regexp_extract({resources}, 'gres/gpu=([0-9]+)', 1), '')"
    return (
        f"coalesce(try_cast(CASE WHEN contains({resources}, 'gres/gpu=') THEN {digits} END AS BIGINT), 0L)"
    )


def first_partition(partitions: str) -> str:
    """First of a comma list of partitions, ``''`` when not logged."""
    return f"coalesce(substring_index({partitions}, ',', 1), '')"


def submit_timestamp(text: str) -> str:
    """Strict ``yyyy-mm-ddThh:mm:ss`` without zone.

    Cast straight to TIMESTAMP_NTZ: going through the session's zone would move
    times that fall into its daylight-saving gaps.
    """
    return f"CASE WHEN {text} RLIKE {string(_SUBMIT)} THEN try_cast({text} AS TIMESTAMP_NTZ) END"


def state_code(state: str, custom_success: Sequence[str] = ()) -> str:
    """1 success, 0 failure, -1 success by the caller's own list, -2 not finished.

    Under ``min`` over the steps of a job, "not finished" outranks the caller's
    list, which outranks failure. Exact match only.
    """
    own = f" WHEN {state} IN ({quoted(custom_success)}) THEN {STATE_CUSTOM_SUCCESS}" if custom_success else ""
    return (
        f"CASE WHEN {state} IN ({quoted(UNFINISHED_STATES)}) THEN {STATE_UNFINISHED} "
        f"WHEN {state} IN ({quoted(SUCCESS_STATES)}) THEN {STATE_SUCCESS}{own} ELSE {STATE_FAILED} END"
    )


def job_id(step_id: str) -> str:
    """Id of the job a step belongs to: the text before the first dot."""
    return f"substring_index({step_id}, '.', 1)"


def parent_job_id(single_job_id: str) -> str:
    """Id of the array a job belongs to: the text before the first underscore."""
    return f"substring_index({single_job_id}, '_', 1)"
