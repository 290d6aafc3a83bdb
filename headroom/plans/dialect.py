"""The few words that Spark SQL and the oracle's SQL spell differently."""

from __future__ import annotations

SPARK = {
    "epoch": lambda x: f"unix_timestamp({x})",
    "div": lambda a, b: f"(({a}) div ({b}))",
    "json": lambda x, path: f"get_json_object({x}, '{path}')",
    "last": lambda x: f"last_value({x}) ignore nulls",
    "first": lambda x: f"first_value({x}) ignore nulls",
    "sorted": lambda x: f"array_sort(collect_list({x}))",
    "at": lambda a, i: f"try_element_at({a}, cast({i} as int))",
    "utc": lambda x: f"timestamp_seconds({x})",
    "day": lambda x: f"date_format(timestamp_seconds({x}), 'yyyy-MM-dd')",
    "money": lambda x: f"format_number({x}, 2)",
    "text": lambda x: f"string({x})",
    "joined": lambda x: f"array_join(array_sort(collect_list({x})), ', ')",
    "kinds": lambda x: f"array_join(array_sort(collect_set({x})), ', ')",
    "tryfloat": lambda x: f"try_cast({x} as double)",
    "trybig": lambda x: f"try_cast({x} as bigint)",
    "iso": lambda x: f"unix_timestamp(try_to_timestamp({x}))",
    "isotext": lambda x: f"date_format(timestamp_seconds({x}), \"yyyy-MM-dd'T'HH:mm:ss'Z'\")",
    "valid": lambda x: f"(try_parse_json({x}) is not null)",
    "parsed": lambda x: f"try_parse_json({x})",
    "got": lambda v, path, kind: f"try_variant_get({v}, '{path}', '{kind}')",
    "object": lambda v, path: f"coalesce(schema_of_variant(try_variant_get({v}, '{path}', 'variant')) like 'OBJECT%', false)",
    "grouped": lambda x: f"format_number({x}, 0)",
    "fixed": lambda x, n: f"format_string('%.{n}f', cast({x} as double))",
    "even": lambda x: f"bround({x}, 0)",
    "every": lambda a, b: f"explode(sequence({a}, {b}))",
    "inf": lambda: "cast('infinity' as double)",
    "pair": lambda a, b: f"struct({a}, {b})",
    "replaced": lambda x, pattern: f"regexp_replace({x}, '{pattern}', '')",
}
DUCK = {
    "epoch": lambda x: f"cast(floor(epoch({x})) as bigint)",
    "div": lambda a, b: f"(({a}) // ({b}))",
    "json": lambda x, path: f"json_extract_string(case when json_valid({x}) then {x} end, '{path}')",
    "last": lambda x: f"last_value({x} ignore nulls)",
    "first": lambda x: f"first_value({x} ignore nulls)",
    "sorted": lambda x: f"list_sort(list({x}))",
    "at": lambda a, i: f"{a}[cast({i} as int)]",
    "utc": lambda x: f"make_timestamp(cast({x} as bigint) * 1000000)",
    "day": lambda x: f"strftime(make_timestamp(cast({x} as bigint) * 1000000), '%Y-%m-%d')",
    "money": lambda x: f"format('{{:,.2f}}', {x})",
    "text": lambda x: f"cast({x} as varchar)",
    "joined": lambda x: f"array_to_string(list_sort(list({x}) filter (where ({x}) is not null)), ', ')",
    "kinds": lambda x: f"array_to_string(list_sort(coalesce(list(distinct {x}) filter (where ({x}) is not null), [])), ', ')",
    "tryfloat": lambda x: f"try_cast({x} as double)",
    "trybig": lambda x: f"try_cast({x} as bigint)",
    "iso": lambda x: f"cast(floor(epoch(try_cast({x} as timestamptz))) as bigint)",
    "isotext": lambda x: f"strftime(make_timestamp(cast({x} as bigint) * 1000000), '%Y-%m-%dT%H:%M:%SZ')",
    "valid": lambda x: f"coalesce(json_valid({x}), false)",
    "parsed": lambda x: f"(case when json_valid({x}) then cast({x} as json) end)",
    "got": lambda v, path, kind: f"try_cast(json_extract_string({v}, '{path}') as {'varchar' if kind == 'string' else kind})",
    "object": lambda v, path: f"coalesce(json_type({v}, '{path}') = 'OBJECT', false)",
    "grouped": lambda x: f"format('{{:,}}', cast({x} as bigint))",
    "fixed": lambda x, n: f"printf('%.{n}f', cast({x} as double))",
    "even": lambda x: f"round_even({x}, 0)",
    "every": lambda a, b: f"unnest(range({a}, {b} + 1))",
    "inf": lambda: "cast('infinity' as double)",
    "pair": lambda a, b: f"row({a}, {b})",
    "replaced": lambda x, pattern: f"regexp_replace({x}, '{pattern}', '', 'g')",
}
