"""Report texts as SQL expressions.

Like functions.parsing, from expression text to expression text. Numbers are
rounded half-even on their exact value (``format_number``).
"""

from __future__ import annotations

from .sql import string

HOUR_S = 3600
DAY_S = 24 * HOUR_S
YEAR_S = 365 * DAY_S


def grouped(value: str, decimals: int) -> str:
    """Fixed decimals with thousands separators."""
    return f"format_number({value}, {decimals})"


def plain(value: str, decimals: int) -> str:
    """Fixed decimals without thousands separators."""
    return f"replace({grouped(value, decimals)}, ',', '')"


def footprint(grams: str, html: bool = False) -> str:
    """gCO2e below one kilogram, kgCO2e below one tonne, else TCO2e."""
    gas = "CO<sub>2</sub>e" if html else "CO2e"
    return (
        f"CASE WHEN {grams} < 1e3D THEN {grouped(grams, 0)} || ' g{gas}' "
        f"WHEN {grams} < 1e6D THEN {grouped(f'{grams} / 1e3D', 0)} || ' kg{gas}' "
        f"ELSE {grouped(f'{grams} / 1e6D', 0)} || ' T{gas}' END"
    )


def tree_months(months: str, split_years: bool = True) -> str:
    whole = f"CAST({months} AS BIGINT)"
    rest = f" || ' and ' || {whole} % 12 || ' tree-months'" if split_years else ""
    return (
        f"CASE WHEN {whole} < 1 THEN {plain(months, 3)} || ' tree-months' "
        f"WHEN {whole} = 1 THEN {plain(months, 1)} || ' tree-month' "
        f"WHEN {whole} < 6 THEN {plain(months, 1)} || ' tree-months' "
        f"WHEN {whole} <= 24 THEN {whole} || ' tree-months' "
        f"WHEN {whole} < 120 THEN {whole} DIV 12 || ' tree-years'{rest} "
        f"ELSE {plain(f'{months} / 12', 1)} || ' tree-years' END"
    )


# Column with the number of flights -> the two ends of the route, shortest first.
ROUTES = {
    "flying_PAR_LON": ("Paris", "London", "Paris - London"),
    "flying_NY_SF": ("New York", "San Francisco", "New York - San Francisco"),
    "flying_NYC_MEL": ("New York", "Melbourne", "New York - Melbourne"),
}


def _by_route(text_of) -> str:
    """The longest route that gives at least half a flight, else the shortest."""
    short, medium, far = ROUTES
    return (
        f"CASE WHEN {medium} < 0.5D THEN {text_of(short)} WHEN {far} < 0.5D THEN {text_of(medium)} "
        f"ELSE {text_of(far)} END"
    )


def flying() -> str:
    """Number of flights on one of the routes, two decimals, a trailing zero dropped."""
    def text(column: str) -> str:
        start, end, _ = ROUTES[column]
        number = grouped(column, 2)
        shown = f"CASE WHEN {number} LIKE '%0' THEN left({number}, length({number}) - 1) ELSE {number} END"
        return f"{shown} || ' flights between {start} and {end}'"

    return _by_route(text)


def flying_number() -> str:
    return f"CAST({_by_route(lambda column: plain(column, 2))} AS DOUBLE)"


def flying_trip() -> str:
    return _by_route(lambda column: string(ROUTES[column][2]))


def driving(km: str) -> str:
    return f"'driving ' || CASE WHEN {km} < 10 THEN {grouped(km, 2)} ELSE {grouped(km, 0)} END || ' km'"


def short_duration(ms: str) -> str:
    """Years from 365 days on, days above two, hours from one on, else seconds."""
    seconds = f"({ms} / 1e3D)"

    def text(unit_s: int, unit: str) -> str:
        value = f"({seconds} / {unit_s})"
        return f"{plain(value, 1)} || ' {unit}' || CASE WHEN CAST({value} AS BIGINT) = 1 THEN '' ELSE 's' END"

    return (
        f"CASE WHEN {seconds} >= {YEAR_S} THEN {text(YEAR_S, 'year')} "
        f"WHEN {seconds} > {2 * DAY_S} THEN {text(DAY_S, 'day')} "
        f"WHEN {seconds} >= {HOUR_S} THEN {text(HOUR_S, 'hour')} "
        f"ELSE {plain(seconds, 2)} || ' seconds' END"
    )


def cost(amount: str, currency: str) -> str:
    return f"{string(currency)} || {grouped(amount, 0)}"


def percent(ratio: str, decimals: int = 2) -> str:
    return f"{plain(f'{ratio} * 100D', decimals)} || '%'"
