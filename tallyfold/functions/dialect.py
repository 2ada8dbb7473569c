"""The few spots where Spark SQL and DuckDB spell the same expression differently."""

from __future__ import annotations


class Spark:
    explode = "explode"

    def s(self, text: str) -> str:
        return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def rep(self, x: str, pattern: str, to: str) -> str:
        return f"regexp_replace({x}, {self.s(pattern)}, {self.s(to)})"

    def like(self, x: str, pattern: str) -> str:
        return f"({x} RLIKE {self.s(pattern)})"

    def all(self, x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract_all({x}, {self.s(pattern)}, {group})"

    def unquote(self, x: str) -> str:
        return f"coalesce(try_url_decode(replace({x}, '+', '%2B')), {x})"

    def quote_plus(self, x: str) -> str:
        return f"replace(replace(url_encode({x}), '%7E', '~'), '*', '%2A')"

    def hex(self, x: str) -> str:
        return f"get_json_object({x}, '$.k')"

    def array(self, *xs: str) -> str:
        return f"array({', '.join(xs)})"

    def json_list(self, x: str) -> str:
        return f"concat('[', array_join(transform({x}, v -> {_ONE.format(v='v')}), ', '), ']')"

    def posexplode(self, x: str, item: str) -> str:
        """Two columns: pos from 0, and the item."""
        return f"posexplode({x}) AS (pos, {item})"

    def json(self, x: str, path: str) -> str:
        return f"get_json_object({x}, {self.s(path)})"

    def compact_json(self, x: str) -> str:
        """A JSON text without blanks between its parts; null where it isn't JSON."""
        return f"to_json(try_parse_json({x}))"

    def json_text(self, x: str) -> str:
        """What a quoted JSON text says."""
        return f"from_json(concat('[', {x}, ']'), 'array<string>')[0]"

    def title(self, x: str) -> str:
        return f"initcap({x})"

    def split(self, x: str, pattern: str) -> str:
        return f"split({x}, {self.s(pattern)})"

    def map(self, x: str, to: str, v: str = "v") -> str:
        return f"transform({x}, {v} -> {to})"

    def filter(self, x: str, test: str, v: str = "v") -> str:
        return f"filter({x}, {v} -> {test})"

    def join(self, x: str, sep: str) -> str:
        return f"array_join({x}, {self.s(sep)})"

    def sorted_set(self, x: str) -> str:
        """An aggregate: the distinct values, sorted."""
        return f"sort_array(collect_set({x}))"

    def iso(self, ts: str) -> str:
        return f"date_format({ts}, {self.s(chr(121) * 4 + '-MM-dd' + chr(39) + 'T' + chr(39) + 'HH:mm:ss' + chr(39) + 'Z' + chr(39))})"

    def unhex_xor(self, x: str) -> str:
        """The text of hex pairs, each by exclusive or with the first."""
        byte = lambda i: f"CAST(conv(substring({x}, {i}, 2), 16, 10) AS INT)"
        return f"array_join(transform(sequence(1, CAST(ceil(length({x}) / 2.0) AS INT) - 1), i -> chr({byte('2 * i + 1')} ^ {byte('1')})), '')"

    def payload(self, pairs: str, *names: str) -> str:
        """An aggregate: rows of columns as one JSON text {pairs: [{...}]}, in order."""
        row = ", ".join(f"'{n}', {n}" for n in names)
        return f"to_json(named_struct('{pairs}', sort_array(collect_list(named_struct({row})))))"

    def entries(self, *pairs: tuple[str, str]) -> str:
        """A map from texts to texts, without pairs whose value is null."""
        made = ", ".join(f"named_struct('key', {self.s(k)}, 'value', {v})" for k, v in pairs)
        return f"map_from_entries(filter(array({made}), e -> e.value IS NOT NULL))"

    def laid_over(self, old: str, new: str) -> str:
        return f"map_concat(map_filter({old}, (k, v) -> NOT map_contains_key({new}, k)), {new})"

    def shown(self, m: str) -> str:
        """A map as text, in order of its keys."""
        return f"array_join(transform(sort_array(map_entries({m})), e -> concat(e.key, '=', e.value)), ';')"

    def keys(self, m: str) -> str:
        return f"sort_array(map_keys({m}))"

    def minutes(self, ts: str) -> str:
        return f"CAST(floor(unix_timestamp({ts}) / 60) AS BIGINT)"

    def json_dict(self, x: str) -> str:
        pair = f"concat({_ONE.format(v='e.key')}, ': ', {_ONE.format(v='e.value')})"
        return f"concat('{{', array_join(transform(map_entries({x}), e -> {pair}), ', '), '}}')"


#: One value as JSON: Spark writes only whole arrays and structs.
_ONE = "substring(to_json(array({v})), 2, length(to_json(array({v}))) - 2)"


class DuckDB:
    explode = "unnest"

    def s(self, text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    def rep(self, x: str, pattern: str, to: str) -> str:
        return f"regexp_replace({x}, {self.s(pattern)}, {self.s(to)}, 'g')"

    def like(self, x: str, pattern: str) -> str:
        return f"regexp_matches({x}, {self.s(pattern)})"

    def all(self, x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract_all({x}, {self.s(pattern)}, {group})"

    def unquote(self, x: str) -> str:
        return f"url_decode({x})"

    def quote_plus(self, x: str) -> str:
        return f"replace(url_encode({x}), '%20', '+')"

    def hex(self, x: str) -> str:
        return f"json_extract_string({x}, '$.k')"

    def array(self, *xs: str) -> str:
        return f"list_value({', '.join(xs)})"

    def json_list(self, x: str) -> str:
        return f"concat('[', array_to_string([CAST(to_json(v) AS VARCHAR) for v in {x}], ', '), ']')"

    def posexplode(self, x: str, item: str) -> str:
        return f"CAST(generate_subscripts({x}, 1) - 1 AS INT) AS pos, unnest({x}) AS {item}"

    def json(self, x: str, path: str) -> str:
        return f"json_extract_string({x}, {self.s(path)})"

    def compact_json(self, x: str) -> str:
        return f"CASE WHEN json_valid({x}) THEN CAST(json({x}) AS VARCHAR) END"

    def json_text(self, x: str) -> str:
        return f"json_extract_string(concat('[', {x}, ']'), '$[0]')"

    def title(self, x: str) -> str:
        return f"array_to_string(list_transform(string_split({x}, ' '), lambda w: concat(upper(substring(w, 1, 1)), lower(substring(w, 2)))), ' ')"

    def split(self, x: str, pattern: str) -> str:
        return f"string_split_regex({x}, {self.s(pattern)})"

    def map(self, x: str, to: str, v: str = "v") -> str:
        return f"list_transform({x}, lambda {v}: {to})"

    def filter(self, x: str, test: str, v: str = "v") -> str:
        return f"list_filter({x}, lambda {v}: {test})"

    def join(self, x: str, sep: str) -> str:
        return f"array_to_string({x}, {self.s(sep)})"

    def sorted_set(self, x: str) -> str:
        return f"list_sort(list(DISTINCT {x}))"

    def iso(self, ts: str) -> str:
        return f"strftime({ts}, '%Y-%m-%dT%H:%M:%SZ')"

    def unhex_xor(self, x: str) -> str:
        byte = lambda i: f"CAST(concat('0x', substring({x}, {i}, 2)) AS INTEGER)"
        return f"array_to_string(list_transform(range(1, CAST(ceil(length({x}) / 2.0) AS INTEGER)), lambda i: chr(xor({byte('CAST(2 * i + 1 AS INTEGER)')}, {byte('1')}))), '')"

    def payload(self, pairs: str, *names: str) -> str:
        row = ", ".join(f"'{n}': {n}" for n in names)
        return f"CAST(to_json({{'{pairs}': list_sort(list({{{row}}}))}}) AS VARCHAR)"

    def entries(self, *pairs: tuple[str, str]) -> str:
        made = ", ".join(f"{{'key': {self.s(k)}, 'value': {v}}}" for k, v in pairs)
        return f"map_from_entries(list_filter([{made}], lambda e: e.value IS NOT NULL))"

    def laid_over(self, old: str, new: str) -> str:
        return f"map_concat({old}, {new})"

    def shown(self, m: str) -> str:
        return f"array_to_string(list_transform(list_sort(map_entries({m})), lambda e: concat(e.key, '=', e.value)), ';')"

    def keys(self, m: str) -> str:
        return f"list_sort(map_keys({m}))"

    def minutes(self, ts: str) -> str:
        return f"CAST(floor(epoch({ts}) / 60) AS BIGINT)"

    def json_dict(self, x: str) -> str:
        return f"concat('{{', array_to_string([concat(CAST(to_json(e.key) AS VARCHAR), ': ', CAST(to_json(e.value) AS VARCHAR)) for e in map_entries({x})], ', '), '}}')"
