"""Text forms of figures, as SQL expressions of either dialect `d`. The reports keep full figures; these are for people."""

from __future__ import annotations


def cents(d, x: str) -> str:
    return f"cast(round(abs({x}) * 100) as bigint)"


def usd(d, x: str) -> str:
    """`$1,846.20`, `-$3.50`, `$?` for NaN; halves of a cent go away from zero."""
    whole, rest = d.grouped(d.div(cents(d, x), "100")), f"lpad({d.text(f'{cents(d, x)} % 100')}, 2, '0')"
    return f"case when isnan({x}) then '$?' else concat(case when {x} < 0 then '-' else '' end, '$', {whole}, '.', {rest}) end"


def usd_whole(d, x: str) -> str:
    """`$15`, never below zero; halves go to the even dollar."""
    return f"case when isnan({x}) then '$?' else concat('$', {d.text(f'cast({d.even(f'greatest({x}, 0)')} as bigint)')}) end"


def count(d, x: str) -> str:
    """`41,218`."""
    return d.grouped(x)


def duration(d, secs: str) -> str:
    """`4d 11h`, `2h 10m`, `5m`."""
    part = lambda a, b: d.text(d.div(a, b))
    return (
        f"case when {secs} >= 86400 then concat({part(secs, '86400')}, 'd ', {part(f'({secs}) % 86400', '3600')}, 'h') "
        f"when {secs} >= 3600 then concat({part(secs, '3600')}, 'h ', {part(f'({secs}) % 3600', '60')}, 'm') else concat({part(secs, '60')}, 'm') end"
    )


def percent(d, x: str) -> str:
    """A share as percent with up to four places: `93.75%`, `50%`."""
    trimmed = d.replaced(d.replaced(d.fixed(f"({x}) * 100", 4), "0+$"), "[.]$")
    return f"case when {x} is not null then concat({trimmed}, '%') end"


def window_word(d, minutes: str) -> str:
    """`weekly`, `2d`, `5h`, `45m`."""
    part = lambda n: d.text(d.div(minutes, str(n)))
    return (
        f"case when {minutes} is null then null when {minutes} = 10080 then 'weekly' when {minutes} % 1440 = 0 then concat({part(1440)}, 'd') "
        f"when {minutes} % 60 = 0 then concat({part(60)}, 'h') else concat({d.text(minutes)}, 'm') end"
    )


def reason_phrase(reason: str) -> str:
    return (
        f"case {reason} when 'low_growth' then 'grew too little' when 'unpriced' then 'has usage without a price' "
        f"when 'usage_gap' then 'usage pauses too long' when 'snapshot_gap' then 'snapshots pause too long' else 'other' end"
    )


def measured(d, secs: str, share: str, requested: str) -> str:
    """`29.0d measured of 30d (97%)`; of all history the share says nothing."""
    days = f"{d.fixed(f'({secs}) / cast(86400 as double)', 1)}"
    if requested == "all":
        return f"concat({days}, 'd measured')"
    return f"concat({days}, 'd measured of {requested} (', {d.fixed(f'({share}) * 100', 0)}, '%)')"
